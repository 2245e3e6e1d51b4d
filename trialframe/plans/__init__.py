"""The experiment's own pipelines, put together from the operators."""
