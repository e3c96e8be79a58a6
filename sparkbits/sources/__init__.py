"""Reading and writing files of bits."""
