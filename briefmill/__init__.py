"""briefmill: a PySpark engine for curating language-model data and evaluating structured model outputs."""

__version__ = "0.1.0"
