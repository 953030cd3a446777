"""Query plans over the driver tables: one registered key per operator of the analysed
application, each with a Spark plan (built from :mod:`panelspark.operators`) and, where
the result is SQL-expressible, an equivalent ANSI SQL text for an independent engine.

Domain mapping used by the keys (the analysed data does not ship, so its roles are
played by the TPC-H-like driver tables):

* station = ``customer`` (``c_custkey``); county = ``nation``; district / state = ``region``;
* daily volume = ``orders.o_totalprice`` per ``o_orderdate``; station-day = per customer;
* current stations = customers outside the AUTOMOBILE segment; retired stations = the
  AUTOMOBILE and BUILDING customers (status = segment) plus every supplier (status
  'SUPPLIER'), so the lists overlap and the retired list repeats ids;
* wide hourly record = ``events`` counted per clock hour (station = ``user_id``,
  direction = ``event_type``);
* case panel = orders per nation and day (cases = orders, deaths = finished orders);
* event timeline = orders read as events (date, category = priority, order type from
  the status, effective when the price exceeds 300 000);
* baseline years 1995-1997, compared years from 1998.
"""

from panelspark.plans.registry import REGISTRY, oracle_sql, queries

__all__ = ["REGISTRY", "oracle_sql", "queries"]
