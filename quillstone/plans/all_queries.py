"""Imports every module that registers queries."""

from quillstone.plans import cues, drafts, everyday, labs, papers, relational, text, usage, views  # noqa: F401
