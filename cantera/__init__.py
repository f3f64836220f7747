"""cantera: price-catalogue and corpus analytics expressed as Spark plans."""

from .lang.syntax import Program, SyntaxFault, parse
from .plans.items import compiled_evaluations, evaluations, items, json_lines, parsed_families, resolve, select_families
from .plans.pricing import fold_lines, priced_concepts
from .session import get_session
from .sources.records import Catalog, decoded, read_records, records, register

__version__ = "0.1.0"
__all__ = [
    "Catalog", "Program", "SyntaxFault", "compiled_evaluations", "decoded", "evaluations", "fold_lines", "get_session", "items", "json_lines", "parse", "parsed_families", "priced_concepts", "read_records", "records", "register", "resolve", "select_families",
]
