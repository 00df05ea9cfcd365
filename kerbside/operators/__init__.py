"""Operators on DataFrames of images, descriptions, points and vectors."""
