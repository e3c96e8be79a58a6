"""Column functions: bit vectors as text, words and packed bytes; conversions and codecs."""
