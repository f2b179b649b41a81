"""Tessera: profile and corpus analytics declared as Spark DataFrames."""
