"""Reading and writing frames, cubes and simulations."""
