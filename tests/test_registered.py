import inspect

import pytest

from seqloom import catalog


@pytest.mark.parametrize(("name", "target"), [("overlap_reads", "seqloom.operators.align.overlap"), ("trained_params", "seqloom.plans.train.train")])
def test_registered_jobs_are_the_operators_own(spark, monkeypatch, name, target):
    """Every pair of reads, and training to its own stop: no option makes the job smaller."""
    from seqloom.operators.align import overlap
    from seqloom.plans.train import train

    defaults, given = inspect.signature({"overlap_reads": overlap, "trained_params": train}[name]).parameters, {}

    def record(*args, **options):
        given.update(options)
        raise StopIteration

    monkeypatch.setattr(target, record)
    with pytest.raises(StopIteration):
        catalog.queries()[name](spark, "/root/testdata/sf0.001")
    assert all(v == defaults[k].default for k, v in given.items())
