"""Serialisation of canonical pairs to text (T1-T9).  Native higher-order
functions over ``attrs``; no Python per row."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Serialisation frames (four modes).
QUESTION_AFTER = "Given the attributes of the two records, are they the same?"
QUESTION_BEFORE = "Given the attributes of two records, are they the same?"

# Prompt templates for instruction-tuned matchers; each has the
# slot for record A before the slot for record B.
PROMPT_TEMPLATES = {
    "jellyfish": (
        "You are an AI assistant that follows instruction extremely well. Help as much as you can.\n\n"
        "### Instruction:\n\n"
        "You are tasked with determining whether two records listed below are the same based on the "
        "information provided.\n"
        "Carefully compare the attributes of each record before making decision.\n"
        "Note: Missing values (N/A or \"nan\") should not be used as a basis for your decision.\n"
        "Record A: [{}]\nRecord B: [{}]\n"
        "Are record A and record B the same entity? Choose your answer from: [Yes, No].\n\n"
        "### Response:\n\n"),
    "mixtral": (
        "[INST]Do the two entity descriptions refer to the same real-world entity? "
        "Answer with 'Yes' if they do and 'No' if they do not.\n"
        "Entity 1: {}\nEntity 2: {}[/INST]"),
    "solar": (
        "### User: Do the two entity descriptions refer to the same real-world entity? "
        "Answer with 'Yes' if they do and 'No' if they do not.\n"
        "Entity 1: {}\nEntity 2: {}\n\n### Assistant:\n"),
    "beluga": (
        "### System:\nYou are Stable Beluga, an AI that follows instructions extremely well.\n\n"
        "### User: Do the two entity descriptions refer to the same real-world entity? "
        "Answer with 'Yes' if they do and 'No' if they do not.\n"
        "Entity 1: {}\nEntity 2: {}\n\n### Assistant:\n"),
}

MODES = ("mode1", "mode2", "mode3", "mode4")


def side_text(side: str, with_names: bool, null_text: str = "N/A", sep: str = ", ",
              attrs: str = "attrs") -> Column:
    """One record's values (``side`` = 'left'/'right') joined; nulls print ``null_text``."""
    def item(a):
        v = F.coalesce(a[side], F.lit(null_text))
        return F.concat(a["name"], F.lit(": "), v) if with_names else F.concat(F.lit("COL "), v)
    return F.array_join(F.transform(F.col(attrs), item), sep)


def serialise_text(mode: str) -> Column:
    """T1-T4 text expression for ``mode``; raises ValueError for an unknown mode (T5)."""
    if mode not in MODES:
        raise ValueError("Invalid mode")
    left, right = side_text("left", mode == "mode4"), side_text("right", mode == "mode4")
    if mode == "mode1":
        parts = [F.lit("Record A is <p>"), left, F.lit("</p>. Record B is <p>"), right,
                 F.lit("</p>. " + QUESTION_AFTER)]
    elif mode == "mode2":
        parts = [F.lit(QUESTION_BEFORE + " Record A is <p>"), left, F.lit("</p>. Record B is <p>"),
                 right, F.lit("</p>.")]
    else:
        parts = [F.lit(QUESTION_BEFORE + " Record A is "), left, F.lit(". Record B is "), right,
                 F.lit(".")]
    return F.concat(*parts)


def serialise(pairs: DataFrame, mode: str = "mode1") -> DataFrame:
    """``pair_id, dataset, split, text, label`` (plus any extra key columns kept)."""
    keep = [c for c in ("fold", "phase") if c in pairs.columns]
    return pairs.select("pair_id", "dataset", "split", *keep,
                        serialise_text(mode).alias("text"), "label")


def attribute_pairs_as_pairs(attr_pairs: DataFrame) -> DataFrame:
    """Attribute pair -> one-attribute canonical pair named 'value'."""
    attrs = F.array(F.struct(F.lit("value").alias("name"), F.col("left_value").alias("left"),
                             F.col("right_value").alias("right"), F.lit(False).alias("numeric")))
    keep = [c for c in ("fold", "phase") if c in attr_pairs.columns]
    return attr_pairs.select(F.col("attr_pair_id").alias("pair_id"), "dataset", "split", *keep,
                             "label", attrs.alias("attrs"))


def serialise_attribute_pairs(attr_pairs: DataFrame, mode: str = "mode1") -> DataFrame:
    return serialise(attribute_pairs_as_pairs(attr_pairs), mode)


def record_text(side: str, sep: str) -> Column:
    """T7 (sep '\\t') / T9 (sep ', '): values joined, nulls print 'nan' (concat_ws would skip them)."""
    return F.array_join(F.transform(F.col("attrs"), lambda a: F.coalesce(a[side], F.lit("nan"))), sep)


def _prompt(template: str, left: Column, right: Column) -> Column:
    if template == "gpt2":
        return serialise_text("mode1")
    if template not in PROMPT_TEMPLATES:
        raise ValueError(f"Model {template} not supported.")
    head, mid, tail = PROMPT_TEMPLATES[template].split("{}")
    return F.concat(F.lit(head), left, F.lit(mid), right, F.lit(tail))


def render_prompt(pairs: DataFrame, template: str) -> DataFrame:
    """Named prompt over tab-joined records; 'gpt2' is serialisation mode1."""
    prompt = _prompt(template, record_text("left", "\t"), record_text("right", "\t"))
    return pairs.select("pair_id", "dataset", "split", prompt.alias("prompt"), "label")


def render_prompts(pairs: DataFrame, templates: Iterable[str]) -> DataFrame:
    """T8 for several templates: ``template`` and the columns of ``render_prompt``, a row each.

    The pairs are read once and each record's text is joined once, whatever the number of templates; without
    templates there are no rows."""
    own = pairs.select("pair_id", "dataset", "split", "label", "attrs",
                       record_text("left", "\t").alias("_left"), record_text("right", "\t").alias("_right"))
    prompts = [F.struct(F.lit(t).alias("template"), _prompt(t, F.col("_left"), F.col("_right")).alias("prompt")) for t in templates]
    rows = F.array(*prompts) if prompts else F.array().cast("array<struct<template:string,prompt:string>>")
    return (own.select("pair_id", "dataset", "split", "label", F.inline(rows))
            .select("template", "pair_id", "dataset", "split", "prompt", "label"))
