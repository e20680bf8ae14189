"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number as reports write it; the metrics in order of precedence, label and noun pattern.
NUMBER = r"\d{1,3}(?:[ ,]\d{3})+|\d+(?:\.\d+)?"
METRICS = [
    ("households", r"households?|hhs?\b|families"),
    ("new arrivals", r"new arrivals?|arrivals?"),
    ("departures", r"departures?"),
    ("returnees", r"returnees|returned individuals|returnee individuals"),
    ("IDPs", r"internally displaced persons|internally displaced people|idps"),
    ("individuals", r"individuals|persons|people|inhabitants"),
    ("camps", r"camps?(?: and camp-like settings?)?|camp-like settings?"),
    ("host communities", r"host communit(?:y|ies)(?: locations)?"),
    ("locations", r"locations|sites|communities|settlements"),
    ("wards", r"wards"),
    ("LGAs", r"local government areas|lgas"),
    ("shelters", r"shelters?|makeshift shelters?"),
    ("herders", r"herders"),
    ("animals", r"animals|livestock|cattle|heads? of cattle"),
    ("alerts", r"alerts"),
    ("fatalities", r"fatalities|deaths|dead|killed"),
    ("injuries", r"injur(?:y|ies)|injured"),
    ("children", r"children"),
    ("women", r"women"),
    ("men", r"men"),
    ("migrants", r"migrants|travell?ers|movements"),
    ("key informants", r"key informants"),
]
#: Subject words by precedence, and labels that name their subject themselves.
SUBJECTS = [("displac", "displaced"), ("fled", "displaced"), ("affect", "affected"), ("regist", "registered"), ("returnee", "returnees"), ("idp", "IDPs"), ("internally displaced", "IDPs"), ("arriv", "arrivals")]
LABEL_SUBJECTS = {"IDPs": "IDPs", "returnees": "returnees", "new arrivals": "arrivals", "departures": "departures"}


def squeeze(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalised(c: Column) -> Column:
    """Lower case, one kind of dash, only letters, digits and _ & / -, one space between words and at both ends."""
    dashes = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[‐-―]", "-")
    kept = F.regexp_replace(dashes, r"(?U)[^\p{L}\p{N}_&/\-\s]", " ")
    return F.concat(F.lit(" "), squeeze(kept), F.lit(" "))


def title_key(c: Column) -> Column:
    """Key under which two titles are the same."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def sentences(c: Column) -> Column:
    """Sentences of 25 to 450 characters that hold a digit."""
    clean = squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), "[\ufffd\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\ue000-\uf8ff]", ""))
    parts = F.transform(F.split(clean, r"(?<=[.;!?])\s+(?=[A-Z0-9(])"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: (F.length(s) >= 25) & (F.length(s) <= 450) & s.rlike(r"\d"))


def sentence_key(c: Column) -> Column:
    """What makes two sentences the same: the first 160 word characters."""
    return F.substring(F.regexp_replace(F.lower(c), r"(?U)[^\p{L}\p{N}_]+", ""), 1, 160)


def last_locate(word: str, c: Column) -> Column:
    """0-based place of the last occurrence, -1 if none."""
    at = F.locate(word[::-1], F.reverse(c))
    return F.when(at > 0, F.length(c) - at - len(word) + 1).otherwise(-1)


def number(c: Column) -> Column:
    return F.regexp_replace(c, "[ ,]", "").try_cast("double")


def subject(sentence: Column) -> Column:
    """Whom a sentence is about, if about one group."""
    t = F.lower(sentence)
    back = t.contains("returnee") | t.contains("returned")
    idp = t.contains("idp") | t.contains("internally displaced")
    return F.when(back & idp, "").when(back, "returnees").when(idp, "IDPs").when(t.contains("displaced") | t.contains("fled"), "displaced").when(t.contains("arriv"), "arrivals").otherwise("")


def subject_place(before: Column) -> Column:
    """struct(at, k, s): the last subject word in the 60 characters before a number: its place (-1: none), its rank below 0, its subject."""
    low = F.lower(before)
    return F.array_max(F.array(*[F.struct(last_locate(w, low).alias("at"), F.lit(-k).alias("k"), F.lit(s).alias("s")) for k, (w, s) in enumerate(SUBJECTS)]))


def local_subject(before: Column, after: Column, label: Column, best: Column | None = None) -> Column:
    """Whom a number is about: by its label, else the nearest subject word in the 60 characters before it, else the
    first listed word in the 30 after it, up to the next digit. Equal places go to the word listed first.

    best is subject_place(before) as a column of its own. Where it isn't given, a lambda binds it: named as an expression, it would be
    evaluated, and its code made, once for each use."""
    low = F.lower(before)
    tail = F.lower(F.split_part(F.regexp_replace(after, r"\d", "\u0001"), F.lit("\u0001"), F.lit(1)))

    def told_by(best: Column) -> Column:
        start = F.greatest(F.lit(0), best["at"] - 12)
        window = F.substring(low, start + 1, best["at"] + 25 - start)
        return F.when(best["at"] >= 0, F.when((best["s"] == "displaced") & window.contains("internally displaced"), "IDPs").otherwise(best["s"]))

    near = told_by(best) if best is not None else F.element_at(F.transform(F.array(subject_place(before)), told_by), 1)
    behind = F.coalesce(*[F.when(tail.contains(w), s) for w, s in SUBJECTS], F.lit(""))
    told = F.coalesce(*[F.when(label == k, v) for k, v in LABEL_SUBJECTS.items()], F.lit(None).cast("string"))
    return F.coalesce(told, near, behind)
