"""Column-expression helpers (JVM-side, codegen friendly)."""

from . import semantics  # noqa: F401
