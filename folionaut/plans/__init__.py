"""Requests and the DataFrame plans that answer them."""
