"""User-facing pipelines, reports and jobs."""
