"""Imports every module that registers queries."""

from matchengine.plans import relational, rules, scores, streams, texts, vectors  # noqa: F401
