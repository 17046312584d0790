"""Plan helpers: materialisation, prefix sums, exact percentiles and connected components."""

from .components import connected_components
from .materialize import drop_materialized, materialize, materialize_alone, scratch_root
from .prefix import running_total
from .quantiles import percentile_columns, percentiles

__all__ = ["connected_components", "drop_materialized", "materialize", "materialize_alone", "percentile_columns", "percentiles", "running_total", "scratch_root"]
