"""Roles and voices of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The four roles' voices and the models that speak.
DEFAULT_VOICES = {"narrator": "Ryan", "adult_male": "Ryan", "adult_female": "Serena", "child": "Vivian"}
NARRATOR_MODEL = "Qwen/Qwen3-TTS-12Hz-0.6B-CustomVoice"
DIALOGUE_MODEL = "Qwen/Qwen3-TTS-12Hz-1.7B-CustomVoice"

#: Overrides up to which they are sent to every task.
BROADCAST_OVERRIDES = 100_000


def role(gender: str = "speaker_gender", is_child: str = "speaker_is_child", is_narrator: str = "is_narrator") -> Column:
    return F.when(F.col(is_narrator), "narrator").when(F.col(is_child), "child").when(F.col(gender) == "male", "adult_male").otherwise("adult_female")


def model_id(is_narrator: Column | str = "is_narrator") -> Column:
    return F.when(F.col(is_narrator) if isinstance(is_narrator, str) else is_narrator, NARRATOR_MODEL).otherwise(DIALOGUE_MODEL)


def assign_voices(lines: DataFrame, overrides: DataFrame | None = None, voices: dict[str, str] | None = None) -> DataFrame:
    """lines with role and voice; an override (speaker, voice) goes before the role's voice, for narrators too."""
    of_role = {**DEFAULT_VOICES, **(voices or {})}
    spoken = lines.withColumn("role", role())
    standard = F.create_map(*(F.lit(x) for kv in of_role.items() for x in kv))[F.col("role")]
    if overrides is None:
        return spoken.withColumn("voice", standard)
    # a cast list is a few names; one beyond the bound is joined by shuffle
    # of clashing overrides the first voice by code points
    pinned = overrides.groupBy("speaker").agg(F.min("voice").alias("__pinned"))
    if pinned.limit(BROADCAST_OVERRIDES + 1).count() <= BROADCAST_OVERRIDES:
        pinned = F.broadcast(pinned)
    return spoken.join(pinned, "speaker", "left").withColumn("voice", F.coalesce("__pinned", standard)).drop("__pinned")


def resolve_lines(lines: DataFrame, overrides: DataFrame | None = None, voices: dict[str, str] | None = None, tone: str | None = "tone") -> DataFrame:
    """Voices assigned, and instruct set: the chapter's tone for narrators (none if tone is None), a speaker's own otherwise."""
    narration = F.col(tone) if tone else F.lit(None).cast("string")
    return assign_voices(lines, overrides, voices).withColumn("instruct", F.when(F.col("is_narrator"), narration).otherwise(F.col("instruct")))
