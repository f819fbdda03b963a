"""String expressions: slugs, labels, ids, annotation answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The closed vocabulary of event phases.
PHASES = ("pre_grasp", "immobilization", "contact", "detach", "post_grasp", "transition")


def _joined(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[^a-zA-Z0-9]+", "_"), "^_+|_+$", "")


def slug(c: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(_joined(c)), F.lit("")), F.lit("task"))


def label(c: Column, max_len: int = 80) -> Column:
    return F.substring(F.coalesce(F.nullif(_joined(c), F.lit("")), F.lit("unnamed")), 1, max_len)


def sample_id(episode: Column, task: Column, rank: Column, step: Column, name: Column) -> Column:
    return F.format_string("ep%04d_task%02d_wp%02d_step%04d_%s", episode, task, rank, step, name)


def pair_id(suite: Column, task: Column, trial: Column, seed: Column) -> Column:
    return F.format_string("%s-task%02d-trial%03d-seed%d", suite, task, trial, seed)


def pair_seed(base: int, task: Column, trial: Column) -> Column:
    return F.lit(base) + task * 10000 + trial


def number_tag(c: Column) -> Column:
    """0.0500 becomes 0p05."""
    return F.translate(F.regexp_replace(F.regexp_replace(F.format_string("%.4f", c), "0+$", ""), "\\.$", ""), ".", "p")


def int_list(c: Column) -> Column:
    """A comma list as distinct integers; null if an entry isn't one."""
    parts = F.transform(F.split(c, ","), lambda x: F.trim(x).try_cast("int"))
    return F.when(~F.exists(parts, lambda x: x.isNull()), F.array_distinct(parts))


def parse_answer(text: Column) -> Column:
    """{phrase, phase} of a JSON answer, with ordered error codes; error is null if both are valid."""
    whole = F.try_parse_json(text)
    is_object = F.coalesce(F.startswith(F.schema_of_variant(whole), F.lit("OBJECT")), F.lit(False))

    def field(name: str) -> Column:
        quoted = F.coalesce(F.schema_of_variant(F.try_variant_get(whole, f"$.{name}", "variant")) == "STRING", F.lit(False))
        return F.when(is_object & quoted, F.trim(F.try_variant_get(whole, f"$.{name}", "string")))

    phrase, phase = F.nullif(field("phrase"), F.lit("")), field("phase")
    errors = F.array_compact(
        F.array(
            F.when(phrase.isNull(), F.lit("missing_or_invalid_phrase")),
            F.when(phase.isNull(), F.lit("missing_or_invalid_phase")).when(~phase.isin(*PHASES), F.concat(F.lit("invalid_phase:"), phase)),
        )
    )
    error = F.when(whole.isNull(), F.lit("json_decode_error")).when(~is_object, F.lit("top_level_json_not_object")).otherwise(F.nullif(F.array_join(errors, "; "), F.lit("")))
    return F.struct(phrase.alias("phrase"), phase.alias("phase"), error.alias("error"))


# The classes of contacts that count as candidates for a collision, and the error codes of answers stand in the expressions here.
COLLISIONS = ("robot_fixture_contact", "gripper_fixture_contact", "robot_object_contact", "robot_self_contact")


def may_collide(contact: Column) -> Column:
    """Is a contact of this class a candidate for a collision?"""
    return contact.isin(*COLLISIONS)


def contact_class(owners: Column) -> Column:
    """Class of a contact from the kinds (before the colon) of all owners of both sides; the first rule that fits holds."""
    kinds = F.array_distinct(F.transform(owners, lambda o: F.split_part(o, F.lit(":"), F.lit(1))))
    has = lambda k: F.array_contains(kinds, k)
    n = F.size(kinds)
    others = F.size(F.filter(kinds, lambda k: ~k.isin("robot", "gripper")))
    return (
        F.when(has("gripper") & has("object"), "gripper_object_manipulation")
        .when(has("robot") & has("fixture"), "robot_fixture_contact")
        .when(has("gripper") & has("fixture"), "gripper_fixture_contact")
        .when(has("robot") & has("object"), "robot_object_contact")
        .when(has("object") & has("fixture") & (n == 2), "object_fixture_contact")
        .when(has("object") & (n == 1), "object_object_contact")
        .when((n > 0) & (others == 0), "robot_self_contact")
        .otherwise("unclassified_contact")
    )
