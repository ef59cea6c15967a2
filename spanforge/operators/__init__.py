"""Dataframe operators: generic over column names."""
