"""Registry of the library's own queries and the SQL that each must agree with."""

from .plans import arrivals as _arrivals  # noqa: F401  registers its queries
from .plans import cadence as _cadence  # noqa: F401  registers its queries
from .plans import extraction as _extraction  # noqa: F401  registers its queries
from .plans import flows as _flows  # noqa: F401  registers its queries
from .plans import markup as _markup  # noqa: F401  registers its queries
from .plans import vocabulary as _vocabulary  # noqa: F401  registers its queries
from .plans import walked as _walked  # noqa: F401  registers its queries
from .plans import whole_texts as _whole_texts  # noqa: F401  registers its queries
from .plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
