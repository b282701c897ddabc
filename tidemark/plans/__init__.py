"""Multi-operator plans: ingest, extraction, reports, monitoring, query catalog."""
