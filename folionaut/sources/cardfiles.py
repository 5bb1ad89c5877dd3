"""Card files: a small helper turns YAML into JSON, and column expressions decide what is a valid card.

One row a file. ``status`` is ``card``, ``not_a_card`` (no mapping, or one that lacks a required field; so is an empty or
null text) or ``invalid`` with the error: text that is no YAML, aliases, repeated or non-text keys, fields of wrong types.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:  # the reader is unavailable without PyYAML
    yaml = None

REQUIRED = ("id", "category", "title", "description", "confidence")
TEXTS = ("subcategory", "positive_text", "negative_text")
LISTS = ("method_texts", "inputs", "outputs", "codes")
# Fixed value: the answer where no card is found.
EMPTY_RESULT = "No Knowledge Cards met the required relevance and confidence thresholds."
_TEXT_TAG = "tag:yaml.org,2002:str"


def _tree(raw: str):
    """The node tree of one document without aliases, whose mappings have distinct text keys; None for an empty text."""
    # An alias begins with an asterisk; a text without one needs no search for them.
    if "*" in raw and any(isinstance(event, yaml.AliasEvent) for event in yaml.parse(raw, Loader=yaml.SafeLoader)):
        raise ValueError("aliases are not accepted")
    root = yaml.compose(raw, Loader=yaml.SafeLoader)
    waiting = [root] if root else []
    while waiting:
        node = waiting.pop()
        if isinstance(node, yaml.MappingNode):
            keys = {key.value for key, _ in node.value if key.tag == _TEXT_TAG}
            if len(keys) < len(node.value):
                raise ValueError("keys must be unique text")
            waiting += [value for _, value in node.value]
        elif isinstance(node, yaml.SequenceNode):
            waiting += node.value
    return root


def yaml_to_json(raw: str | None) -> tuple[str | None, str | None]:
    """(JSON, error). What JSON lacks (dates, binary values, sets) becomes an object, which is no text in any field."""
    try:
        root = _tree(raw or "")
        # Built from the checked tree: the text is read once.
        value = None if root is None else yaml.SafeLoader("").construct_document(root)
        return json.dumps(value, allow_nan=False, default=lambda value: {"other": str(value)}), None
    except (yaml.YAMLError, ValueError, TypeError, RecursionError) as error:
        return None, str(error) or type(error).__name__


def _converted(raw: Column) -> Column:
    @F.pandas_udf("struct<json:string,error:string>")
    def convert(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([yaml_to_json(one) for one in batch], columns=["json", "error"], dtype=object)

    # Not repeatable in name: otherwise the planner may convert once for each rule that looks at the result.
    return convert.asNondeterministic()(raw)


def _kind(card: Column, name: str) -> Column:
    """The type of a field's value, and null where the card lacks the field."""
    return F.schema_of_variant(F.variant_get(card, f"$.{name}", "variant"))


def _problem(card: Column) -> Column:
    """The first rule that a card with all required fields breaks; null if none."""
    text = lambda name: F.variant_get(card, f"$.{name}", "string")
    named, number = _kind(card, "confidence"), F.try_variant_get(card, "$.confidence", "double")
    wrong_text = lambda name: F.when(_kind(card, name) == "STRING", ~text(name).rlike(r"(?U)\S")).otherwise(True)
    rules = [(wrong_text(name), f"{name} must be text that is not blank") for name in ("id", "category", "title", "description")]
    real = named.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$") & number.between(0, 1)
    rules.append((~F.coalesce(real, F.lit(False)), "confidence must be a number from 0 to 1"))
    rules += [(_kind(card, name) != "STRING", "text fields must be text") for name in TEXTS]
    for name in LISTS:
        rules.append((~_kind(card, name).isin("ARRAY<STRING>", "ARRAY<VOID>") | _holds_null(card, name), f"{name} must be a list of texts"))
    rules.append((~_kind(card, "costs").startswith("OBJECT<"), "costs must be a mapping"))
    references = F.try_variant_get(card, "$.source", "array<map<string,variant>>")
    texts_only = F.forall(references, lambda r: F.coalesce(F.forall(F.map_values(r), lambda v: F.schema_of_variant(v) == "STRING"), F.lit(False)))
    rules.append((_kind(card, "source").isNotNull() & ~F.coalesce(texts_only, F.lit(False)), "source must be a list of mappings of texts"))
    return F.coalesce(*[F.when(wrong, F.lit(message)) for wrong, message in rules])


def _holds_null(card: Column, name: str) -> Column:
    return F.exists(F.try_variant_get(card, f"$.{name}", "array<string>"), F.isnull)


def read_cards(files: DataFrame) -> DataFrame:
    """Rows (source_id, text) to parse results; ``first_per_key`` then decides about repeated ids. Other columns are left out."""
    found = files.select("source_id", F.col("text").alias("raw_yaml"), _converted(F.col("text")).alias("_c"))
    cards = found.select("source_id", "raw_yaml", F.col("_c.error").alias("_error"), F.parse_json("_c.json").alias("_card"))
    card = F.col("_card")
    whole = F.schema_of_variant(card).startswith("OBJECT<")
    for name in REQUIRED:
        whole = whole & _kind(card, name).isNotNull()
    whole = F.coalesce(whole, F.lit(False))
    # Rules are judged once; fields are read only from cards that keep them all.
    judged = cards.withColumn("error", F.when(F.col("_error").isNotNull(), F.col("_error")).when(whole, _problem(card)))
    status = F.when(F.col("error").isNotNull(), "invalid").when(whole, "card").otherwise("not_a_card")
    kept = F.when(status == "card", card)
    field = lambda name, kind: F.variant_get(kept, f"$.{name}", kind)
    given = lambda name, kind, empty: F.when(status == "card", F.coalesce(field(name, kind), empty)).alias(name)
    texts, pairs = "array<string>", "map<string,string>"
    return judged.select(
        "source_id", status.alias("status"), "error", field("id", "string").alias("card_id"),
        *[given(name, "string", F.lit("")) for name in ("category", "subcategory", "title", "description", "positive_text", "negative_text")],
        field("confidence", "double").alias("confidence"),
        *[given(name, texts, F.array().cast(texts)) for name in LISTS],
        given("costs", pairs, F.create_map().cast(pairs)),
        given("source", f"array<{pairs}>", F.array().cast(f"array<{pairs}>")),
        F.when(status == "card", F.col("raw_yaml")).alias("raw_yaml"),
    )


def dump_cards(raw_cards: list[str]) -> str:
    """The cards of one answer as YAML documents without their ids; a fixed sentence when there are none.

    The nodes of the texts are written again in block form, texts of several lines as literal blocks.
    """
    roots = [_tree(raw) for raw in raw_cards]
    for root in roots:
        root.value = [(key, value) for key, value in root.value if key.value != "id"]
        waiting = [root]
        while waiting:
            node = waiting.pop()
            if isinstance(node, yaml.ScalarNode):
                node.style = "|" if "\n" in node.value and node.tag == _TEXT_TAG else None
            else:
                node.flow_style = not node.value
                waiting += [part for item in node.value for part in (item if isinstance(item, tuple) else (item,))]
    if not roots:
        return EMPTY_RESULT
    return yaml.serialize_all(roots, Dumper=yaml.SafeDumper, allow_unicode=True, explicit_start=True)
