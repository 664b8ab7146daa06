"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import decontaminate, lexical_search, license_scan, periodic_runs, quality_rules, substring_dedup
from .decontaminate import op9_benchmark_decontamination
from .lattice_lm import op6_lattice_scores
from .lexical_search import op11_lexical_search
from .license_scan import op10_license_scan
from .line_dedup import op3_line_dedup
from .mixing import op2_source_mixing
from .near_dedup import op1_minhash_near_dedup
from .periodic_runs import op12_periodic_runs
from .quality_rules import op7_quality_rules
from .substring_dedup import op5_substring_dedup
from .surrogates import op4_pii_surrogates
from .token_counts import op8_token_counts
from .toxicity import op13_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_source_mixing,
        op3_line_dedup,
        op4_pii_surrogates,
        op5_substring_dedup,
        op6_lattice_scores,
        op7_quality_rules,
        op8_token_counts,
        op9_benchmark_decontamination,
        op10_license_scan,
        op11_lexical_search,
        op12_periodic_runs,
        op13_toxicity,
    )
}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLES: dict[str, str] = {
    "op5_substring_dedup": substring_dedup.SQL,
    "op7_quality_rules": quality_rules.SQL,
    "op9_benchmark_decontamination": decontaminate.SQL,
    "op10_license_scan": license_scan.sql(),
    "op11_lexical_search": lexical_search.SQL,
    "op12_periodic_runs": periodic_runs.SQL,
}
