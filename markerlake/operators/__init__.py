"""Relational operators over pixels, boundary points, codes and boxes."""
