"""Column builders: time frames, keys, fixed-point numbers, flags, enumerations, texts and funding payments."""
