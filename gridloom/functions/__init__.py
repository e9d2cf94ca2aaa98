"""Column expressions: grid cells, geometry on the sphere, decoding and resampling weights."""
