"""Whole jobs: training, research grids, inference, and the service's routes as functions."""
