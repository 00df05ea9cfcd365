"""Tables, files and images, and where they come from."""
