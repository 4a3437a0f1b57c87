"""Each query against its SQL on the smallest tables."""

import numpy as np
import pytest

from fluxgrain.plans import queries as Q

SF = "/root/testdata/sf0.001"
FAST = [
    "clean_labels", "clean_infinite", "clean_timestamps", "clean_day_tag", "clean_synthetic_timeline", "label_codes", "label_counts", "bin_series", "bin_series_odd_width",
    "bin_labels", "window_labels_any", "win_hopping", "win_deltas", "psd_catalyst", "psd_arrow", "spectral_descriptors", "flow_window_pool", "raw_window_features",
    "metric_auc", "metric_roc", "threshold_f1", "threshold_fpr", "threshold_percentile", "metric_evaluate", "per_class",
    "threshold_methods", "describe_flows", "distinct_per_day", "semi_join_days", "day_against_rest", "finite_or_zero", "running_counts", "places",
]


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, duck, name):
    got, want = Q.QUERIES[name](spark, SF).toPandas(), duck.execute(Q.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    got, want = got[cols].sort_values(cols).reset_index(drop=True), want[cols].sort_values(cols).reset_index(drop=True)
    assert len(got) == len(want)
    for c in cols:
        if got[c].dtype.kind == "f":  # the engines may round the last digit of a quotient differently
            np.testing.assert_allclose(got[c].to_numpy(), want[c].to_numpy(float), rtol=1e-9, atol=1e-9, err_msg=c)
        else:
            assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


def test_every_sql_has_a_query():
    assert set(Q.SQL) <= set(Q.QUERIES)
