"""Relational operators: manifests, results, profiles, messages, stages, telemetry, evaluation, image features."""
