"""A strictly typed dataframe engine on Spark: typed expressions are checked first, then lowered to Catalyst."""

from .errors import ExprError, FrameError
from .functions.expr import Expr, col, lit
from .operators.frame import Frame, scope
from .plans.compile import compile_expr, compile_filter, infer_type, resolve, schema_of
from .sources.read import from_arrow, read_csv, read_json, read_parquet
from .types import DTYPES

__version__ = "0.1.0"
__all__ = ["DTYPES", "Expr", "ExprError", "Frame", "FrameError", "col", "compile_expr", "compile_filter", "from_arrow", "infer_type", "lit", "read_csv", "read_json", "read_parquet", "resolve", "schema_of", "scope"]
