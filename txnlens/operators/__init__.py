"""DataFrame -> DataFrame operators, one per analysed statement."""

from . import audit, cleaning, customers, features, geography, kpis, transactions, velocity  # noqa: F401
from .cleaning import clean, validated  # noqa: F401
from .features import features as build_features  # noqa: F401
