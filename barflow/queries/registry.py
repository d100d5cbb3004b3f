"""All registered queries; importing a module registers what it holds."""

from barflow.queries.base import QUERIES, SQL  # noqa: F401
from barflow.queries import indicator_queries  # noqa: F401
from barflow.queries import label_queries  # noqa: F401
from barflow.queries import join_queries  # noqa: F401
from barflow.queries import quality_queries  # noqa: F401
from barflow.queries import stats_queries  # noqa: F401
from barflow.queries import report_queries  # noqa: F401
from barflow.queries import path_queries  # noqa: F401
from barflow.queries import source_queries  # noqa: F401
from barflow.queries import stream_queries  # noqa: F401
from barflow.queries import model_queries  # noqa: F401
