"""Tidewright: data selection and corpus preparation as PySpark DataFrame plans."""
