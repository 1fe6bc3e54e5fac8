"""Text problems of training corpora. Nothing else in the library imports this package."""
