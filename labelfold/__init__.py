"""labelfold — text categorisation and ledger/feedback analytics on PySpark.

Every operator is a function ``DataFrame -> DataFrame`` built from the
DataFrame API, so Catalyst sees one declarative plan per query.  Most
operators take ``by: list[str]``: ``by=[]`` is one global model / metric,
``by=["user_id"]`` the personalised per-user variant.
"""

__version__ = "0.1.0"
