"""Training-data operators: a self-contained subpackage that the rest of the library never imports."""
