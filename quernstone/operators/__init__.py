from quernstone.operators.activity import trailing_distinct
from quernstone.operators.grids import interpolated
from quernstone.operators.heavy_hitters import heavy_hitters
from quernstone.operators.joins import (
    asof_join,
    except_all,
    intersect_all,
    interval_counts,
    interval_join,
)
from quernstone.operators.overlaps import overlap_join
from quernstone.operators.patterns import VALLEYS, Automaton, matches
from quernstone.operators.percentiles import exact_percentiles
from quernstone.operators.samples import weighted_sample
from quernstone.operators.sessions import funnel, sessionize
from quernstone.operators.windows import sliding, top_k_per_key, trailing, tumbling

__all__ = [
    "VALLEYS",
    "Automaton",
    "asof_join",
    "except_all",
    "exact_percentiles",
    "funnel",
    "heavy_hitters",
    "intersect_all",
    "interpolated",
    "interval_counts",
    "interval_join",
    "matches",
    "overlap_join",
    "sessionize",
    "sliding",
    "top_k_per_key",
    "trailing",
    "trailing_distinct",
    "tumbling",
    "weighted_sample",
]
