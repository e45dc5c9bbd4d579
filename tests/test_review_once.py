"""What a reviewer's log leaves is worked out once, however many steps read it."""

from paperloom.operators import review
from paperloom.workload import numbering


def test_layout_replays_a_log_once(spark, small, monkeypatch):
    replayed, ordered = [], []
    replay, running = review.reviewed_regions, review.running

    def counted(*args):
        replayed.append(1)
        return replay(*args)

    def seen(df, *args, **kwargs):
        ordered.append(df._jdf.queryExecution().optimizedPlan().toString())
        return running(df, *args, **kwargs)

    monkeypatch.setattr(review, "reviewed_regions", counted)
    monkeypatch.setattr(review, "running", seen)
    numbering.reviewed_layout(spark, small)
    assert len(replayed) == 1
    # Pages are put in order from a written copy, not from the histories again for each of the three readings.
    assert len(ordered) == 1 and "Window" not in ordered[0] and "Aggregate" not in ordered[0]
