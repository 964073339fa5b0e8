"""tidemark: time-series feature, backtest and drift jobs on PySpark."""

from tidemark.roles import Roles
from tidemark.session import local_session, materialize

__all__ = ["Roles", "local_session", "materialize"]
