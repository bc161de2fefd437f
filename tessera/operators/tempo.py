"""How speech and picture are fitted to each other: by playing either faster or slower within limits, and else by cutting or by silence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The fastest and slowest play of a dub, how much longer it may be unnoticed, and the longest gap after it.
FASTEST_DUB, SLOWEST_DUB, UNNOTICED, LONGEST_GAP, CUT_NOTICED = 1.4, 0.85, 0.15, 0.25, 0.3
#: How far a picture is stretched for its dub, and how far footage is slowed down.
MOST_STRETCH, MOST_SLOW, LEAST_TAKE, NEARLY = 1.5, 1.6, 0.4, 1.02


def dub_stretch(planned: Column, dub: Column) -> Column:
    """How many times as long a picture becomes whose dub does not fit even at its fastest."""
    fits = (dub <= 0) | (planned <= 0) | (dub <= planned * FASTEST_DUB + UNNOTICED)
    return F.when(fits, 1.0).otherwise(F.least(F.lit(MOST_STRETCH), dub / FASTEST_DUB / planned))


def dub_plan(video: Column, voice: Column) -> Column:
    """struct<tempo, cut, silent>: at which tempo a dub is laid under a picture, and how many seconds of it are cut off, or of silence follow (null: none worth a note).

    A dub that is longer is played faster, one that leaves a gap slower; pictures up to 0.2 seconds, and dubs as short that leave a gap, stay as they are.
    """
    longer = (video > 0.2) & (voice > video + UNNOTICED)
    shorter = (video > 0.2) & (voice > 0.2) & (voice < video - LONGEST_GAP)
    tempo = F.when(longer, F.least(F.lit(FASTEST_DUB), voice / video)).when(shorter, F.greatest(F.lit(SLOWEST_DUB), voice / video)).otherwise(1.0)
    played = voice / tempo
    return F.struct(
        F.round(tempo, 3).alias("tempo"), F.when(longer & (played > video + CUT_NOTICED), F.round(played - video, 2)).alias("cut"),
        F.when(~longer & shorter & (video - played > LONGEST_GAP), F.round(video - played, 2)).alias("silent"),
    )


def slowed_take(available: Column, need: Column) -> Column:
    """struct<take, speed, seconds>: how much footage is taken for a need, played how fast, and how long that is; footage that is too short is slowed down to 1/1.6 at most."""
    take = F.greatest(F.lit(LEAST_TAKE), F.least(available, need))
    speed = F.when(need > take * NEARLY, F.greatest(F.lit(1 / MOST_SLOW), take / need)).otherwise(1.0)
    return F.struct(F.round(take, 2).alias("take"), F.round(speed, 3).alias("speed"), F.round(take / speed, 2).alias("seconds"))


#: The least share of a line that must be heard, what follows its last character, how late it may end, and the fastest play that keeps it.
LEAST_HEARD, TAIL, LATE, FASTEST_SPEECH = 0.5, 0.12, 0.25, 1.5


def speech_fit(need: Column, length: Column, until: Column, cover: Column) -> Column:
    """struct<outcome, tempo, ends>: how a generated piece of some length is fitted to the time it should take, by when its line has been said (until) and how much of it is heard (cover).

    "cut": the line ends in time, and the rest is cut off; "faster": the piece is played at tempo, so that the line is heard whole; "cut_short": that would be too fast, so the line loses its
    end; "unsaid": the line is hardly heard, so it is dubbed instead; "too_short": no time for a line. ends is when the line ends with its tail.
    """
    ends = F.least(length, until + TAIL)
    tempo = ends / F.nullif(need, F.lit(0.0))
    outcome = (
        F.when(need < LEAST_TAKE, "too_short").when(cover < LEAST_HEARD, "unsaid").when(ends <= need + LATE, "cut").when(tempo <= FASTEST_SPEECH, "faster").otherwise("cut_short")
    )
    asked = outcome.isin("faster", "cut_short")
    return F.struct(outcome.alias("outcome"), F.when(asked, F.round(tempo, 3)).alias("tempo"), F.when(~outcome.isin("too_short", "unsaid"), F.round(ends, 2)).alias("ends"))
