"""Duplicates hidden by formatting differences (problem 1).

Canonical records are range-partitioned and externally sorted; a scan of each
sorted partition compares every full key with the one before it.  The range
bounds include item_id, so a record with very many copies is spread over several
partitions; runs that cross a boundary are joined through two rows per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrain.llm.ranked import run_counts, run_members
from loomgrain.llm.textkeys import letters_digits

# The names of a prompt's fields in this project.
PROMPT_FIELDS = ("scene", "lettering", "material", "sign colour", "frame colour", "place", "size")


def prompt_key(c: Column, fields: tuple[str, ...] = PROMPT_FIELDS) -> Column:
    """Canonical form of a prompt: ``N`` + sorted fields, ``F`` + letters and digits, or ''.

    A prompt that is a JSON object, or that names at least two of ``fields``
    followed by ``:`` or ``=``, is a list of named fields: its (name, value)
    pairs are compared as a set.  Anything else is free text.
    """
    names = "|".join(r"[^\p{L}\p{N}]*".join(f.split()) for f in fields)
    label = rf"(?i)(?<![\p{{L}}\p{{N}}])({names})[\s\"'*_]*[:=]"
    pair = lambda k, v: F.concat(letters_digits(k), F.lit("="), F.coalesce(letters_digits(v), F.lit("")))
    parsed = F.from_json(c, "map<string,string>")
    of_json = F.transform(F.map_entries(parsed), lambda e: pair(e["key"], e["value"]))
    labels = F.regexp_extract_all(c, F.lit(label), 1)
    parts = F.split(c, label, -1)
    head = letters_digits(F.get(parts, F.lit(0)))
    of_list = F.zip_with(labels, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), pair)
    of_list = F.when(head != "", F.array_append(of_list, F.concat(F.lit("="), head))).otherwise(of_list)
    joined = lambda a: F.concat(F.lit("N"), F.array_join(F.array_sort(F.array_distinct(a)), "\u001f"))
    plain = letters_digits(c)
    free = F.when(plain == "", F.lit("")).otherwise(F.concat(F.lit("F"), plain))
    looks_json = F.ltrim(c).startswith("{")
    looks_list = c.rlike(r"[:=]") & (F.regexp_count(c, F.lit(label)) >= 2)
    return F.coalesce(
        F.when(looks_json & (F.size(parsed) >= 1), joined(of_json)),
        F.when(looks_list, joined(of_list)),
        free,
        F.lit(""),
    )


def canonical(items: DataFrame) -> DataFrame:
    """(item_id, key) of the rows that have a query or a prompt; null and blank agree."""
    query = F.coalesce(letters_digits(F.col("query")), F.lit(""))
    prompt = prompt_key(F.col("prompt"))
    rows = items.select("item_id", F.concat(query, F.lit("\u001e"), prompt).alias("key"))
    return rows.where((F.col("key") != "\u001e") & F.col("item_id").isNotNull())


def found_duplicates(items: DataFrame, name: str = "copies") -> DataFrame:
    """One row (first_id, item_id) for each row but the first of its record.

    ``items``: item_id, query, prompt; other columns are ignored.  Rows with
    neither query nor prompt (null, blank or without letters and digits) and
    rows without item_id are left out.  ``first_id`` is the smallest item_id of
    the record; an item_id that is delivered twice counts once.  Empty table: no rows.
    """
    return run_members(canonical(items), name)


def record_counts(items: DataFrame, name: str = "records") -> DataFrame:
    """(first_id, n_rows): one representative per record and the rows it stands for."""
    return run_counts(canonical(items), name)
