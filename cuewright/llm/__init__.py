"""Operators that prepare text for training and evaluating language models. Nothing outside imports this."""
