"""DataFrame operators, by topic: see the modules."""

from retentia.operators.explain import (
    attributions,
    attributions_within,
    compare_rankings,
    impurity_importance,
    linear_attributions,
    mean_abs_attribution,
    permutation_importance,
    rank_importance,
    shuffle_importance,
    split_importance,
)
from retentia.operators.joins import assert_unique_key, assert_unique_keys, join_one_to_one, with_globals
from retentia.operators.levels import level_dictionary, target_means, with_level_numbers
from retentia.operators.metrics import (
    average_precision,
    best_f1_threshold,
    classification_report,
    pr_curve,
    roc_auc,
    score_curve,
)
from retentia.operators.models import (
    assemble,
    class_weights,
    cross_validate,
    fit_boosted,
    fit_forest,
    fit_logistic,
    out_of_fold_scores,
    score,
    staged_auc,
    stratified_split,
    with_class_weight,
)
from retentia.operators.ordered import event_gaps, event_number, gap_counts, moving_average, running_totals, timeline_profile
from retentia.operators.prepare import (
    activity_flags,
    collapse_duplicate_columns,
    coverage_flags,
    fill_counts,
    fill_median,
    fill_recency,
    fill_std_zero,
    final_fill,
    log1p_features,
    missing_flags,
    one_hot,
    select_by_type,
    spend_ratio,
    standardize,
    winsorize_upper,
)
from retentia.operators.profile import box_summary, crosstab_share, histogram
from retentia.operators.quality import (
    dedupe_report,
    duplicate_count,
    enforce,
    fan_out,
    global_stats,
    integrity_report,
    missing_share,
    table_report,
    valid_counts,
    value_counts,
)
from retentia.operators.quantiles import column_quantiles, exact_quantiles
from retentia.operators.sketches import merged_sketches, rank_errors, sketch_quantiles, value_sketches
from retentia.operators.rollup import (
    active_months,
    online_profile,
    service_profile,
    since,
    snapshot_date,
    trailing_features,
    transaction_profile,
    weekly_counts,
)

__all__ = [
    name for name, value in list(globals().items()) if callable(value) and getattr(value, "__module__", "").startswith(__name__)
]
