"""alertflow: alert routing, muting, delivery de-duplication and alert-state
analytics expressed as Spark DataFrame jobs.

Every public function takes and returns DataFrames or Columns; time is always
an argument (a column such as ``observed_at`` in a replay, or a literal
``as_of`` in a listing), so the same code serves batch replays and
Structured Streaming micro-batches.
"""

from alertflow.session import build_session, ensure_checkpoint_dir, materialize  # noqa: F401

__all__ = ["build_session", "ensure_checkpoint_dir", "materialize"]
