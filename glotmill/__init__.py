"""A PySpark engine for analysing code-mixed, multi-label short text."""
