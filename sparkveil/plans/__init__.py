"""Registered queries over the driver's tables, with the SQL that checks them."""

from .charts import CHARTS
from .files import FILES
from .protection import PROTECTION
from .reports import REPORTS
from .sentences import SENTENCES

_ALL = {**PROTECTION, **REPORTS, **CHARTS, **SENTENCES, **FILES}
QUERIES = {name: q.run for name, q in _ALL.items()}
ORACLE_SQL = {name: q.sql for name, q in _ALL.items() if q.sql}
