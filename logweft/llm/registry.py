"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import OP3_SQL, op3_prefix_targets
from .fingerprints import op9_simhash_fingerprints
from .lm import op1_elias_fano_lm
from .mixing import OP10_SQL, op10_systematic_mix
from .neardup import op5_bktree_neardup
from .packing import op6_histogram_best_fit
from .pii import op8_contextual_pii
from .quality import op7_robust_outliers
from .sharding import op4_histogram_sort
from .toxicity import op2_nearest_toxic


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_elias_fano_lm,
        op2_nearest_toxic,
        op3_prefix_targets,
        op4_histogram_sort,
        op5_bktree_neardup,
        op6_histogram_best_fit,
        op7_robust_outliers,
        op8_contextual_pii,
        op9_simhash_fingerprints,
        op10_systematic_mix,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_prefix_targets": OP3_SQL, "op10_systematic_mix": OP10_SQL}
