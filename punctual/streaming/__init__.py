"""The rollup over a stream."""
