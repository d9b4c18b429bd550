"""Structured Streaming: score labelled pairs as their files arrive."""
