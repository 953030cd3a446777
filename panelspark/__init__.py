"""panelspark: Spark-native analytics for daily panel data.

Every public function is a ``DataFrame -> DataFrame`` (or ``Column``) transform: no
actions, no sessions, no driver-side loops.  Compose them with ``df.transform``.
"""

__version__ = "0.1.0"
