"""End-to-end plans: the Process pipeline and the query catalog."""
