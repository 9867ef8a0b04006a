"""tradelens: marketplace reports (revenue, payments, freight, reviews,
loyalty, products, review word frequency) as PySpark DataFrame operators."""

__version__ = "0.1.0"
