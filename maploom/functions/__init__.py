"""Column functions: frames, scales, colours, hashes, geometry on arrays, text."""
