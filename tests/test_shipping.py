"""Kernels where the executors hold no copy of the package."""

import os

import pytest

from tests.far import failures

DATA = "/root/testdata/sf0.001"
KERNELS = ["disjoint_best_fits", "deconvolute_graph", "isotopic_cluster", "pick_peaks", "trace_features", "cluster_scans", "shape_fit", "profile_split", "deconvolute_compositions", "trace_mass_features", "mzml_roundtrip", "mgf_roundtrip", "function_scorer", "callable_filter", "retention_hook", "task_over_ranges", "stream_interleaved_groups"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_kernels_need_no_package_on_the_executors():
    assert failures(DATA, KERNELS) == ""
