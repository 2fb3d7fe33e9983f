"""tickforge: a PySpark-native engine for governed market time series and cited retrieval.

Every operator is a function from DataFrames to a DataFrame. Operators never build a session; the
caller passes one. Training-data operators on texts live in ``tickforge.llm``, which nothing else imports.
"""

__version__ = "0.1.0"
