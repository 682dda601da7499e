"""Registered queries over the given tables, each with an independent SQL oracle where SQL can say it."""

from entries import checks, files, maintenance, recommend, resolution, retrieval, screens, staging, streams, texts

ALL_MODULES = [recommend, maintenance, staging, resolution, files, checks, texts, screens, retrieval, streams]
