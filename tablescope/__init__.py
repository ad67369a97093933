"""Discovery, joins, profiling, analysis and audit of sets of tables on Spark."""

from .operators.discover import Discovery, discover
from .operators.joins import JoinInstruction, merge, run_joins
from .operators.profile import Profile, TablePlan, full_profile, profile_tables
from .session import build_session
from .sources import TableSet, load_catalog, load_csv, load_jdbc, load_table_set

__all__ = [
    "Discovery",
    "JoinInstruction",
    "Profile",
    "TablePlan",
    "TableSet",
    "build_session",
    "discover",
    "full_profile",
    "load_catalog",
    "load_csv",
    "load_jdbc",
    "load_table_set",
    "merge",
    "profile_tables",
    "run_joins",
]
