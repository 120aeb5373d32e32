"""Text normalisation, option lists, prompts and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"\s+"
#: Accented letters become a word character that is neither a letter nor a digit, so that \b means the same in Java and RE2.
FOLDED_LETTERS = "[À-ÖØ-öø-ÿĀ-ſ]"


def query_text(s: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(s, _SPACE, " "))


def match_text(s: Column) -> Column:
    """Lower case, anything but 0-9, a-z and white space as a space, runs of white space as one."""
    return query_text(F.regexp_replace(F.lower(s), r"[^0-9a-z\s]", " "))


def optional_text(s: Column) -> Column:
    return F.nullif(F.trim(s), F.lit(""))


def optional_number(x: Column) -> Column:
    """Negative numbers mean none."""
    return F.when(x >= 0, x)


def truth(s: Column) -> Column:
    return F.lower(F.trim(s)).isin("1", "true", "yes", "y", "on")


def whole_number(s: Column) -> Column:
    """Of text: a whole number, else null; true and false are no numbers."""
    return F.when(~F.lower(F.trim(s)).isin("true", "false"), F.try_to_number(s, F.lit("S999999999999999999")).cast("long"))


def real_number(s: Column) -> Column:
    """Of text: a number, else null; true and false are no numbers."""
    return F.when(~F.lower(F.trim(s)).isin("true", "false"), s.try_cast("double"))


def strict_prediction(s: Column) -> Column:
    """Digits as a number; anything else, null included, is an error."""
    return F.when(F.coalesce(F.trim(s.cast("string")), F.lit("")).rlike("^[0-9]+$"), F.trim(s.cast("string")).cast("long")).otherwise(F.raise_error(F.concat(F.lit("not a prediction: "), F.coalesce(s.cast("string"), F.lit("null")))).cast("long"))


def question_uid(video: Column, qid: Column, row_number: Column) -> Column:
    """video:qid, with the video named once; without a qid the row number."""
    given = optional_text(qid)
    return F.when(given.isNull(), row_number.cast("string")).when(F.startswith(given, F.concat(video, F.lit(":"))), given).otherwise(F.concat_ws(":", video, given))


def first_present(*candidates: Column) -> Column:
    return F.coalesce(*[optional_text(c.cast("string")) for c in candidates])


def answer_index(value: Column) -> Column:
    """0-based: digits as they are, a letter by its place in the alphabet."""
    v = F.upper(F.trim(value.cast("string")))
    return F.when(v.rlike("^[0-9]+$"), v.cast("int")).when(v.rlike("^[A-Z]$"), F.ascii(v) - 65)


def option_letter(index: Column) -> Column:
    return F.when(index >= 0, F.char(65 + index))


def first_letter(s: Column) -> Column:
    """First character in upper case, '' for null."""
    return F.upper(F.substring(F.trim(F.coalesce(s, F.lit(""))), 1, 1))


def text_answer_index(answer: Column, options: Column) -> Column:
    """Place of the first option that equals the answer in match_text() form, null if none."""
    return F.nullif(F.array_position(F.transform(options, match_text), match_text(answer)) - 1, F.lit(-1))


def split_options(s: Column) -> Column:
    """'[A. one, B. two]' as an array of options, letters kept off."""
    inner = F.regexp_replace(F.trim(s), r"^\[|\]$", "")
    return F.transform(F.split(inner, r",\s*(?=[A-Z]\.\s)"), lambda x: F.trim(F.regexp_replace(x, r"^[A-Z]\.\s*", "")))


def option_block(options: Column, lettered: bool = False) -> Column:
    name = (lambda i: option_letter(i)) if lettered else (lambda i: i.cast("string"))
    head, sep = ("", ". ") if lettered else ("Option ", ": ")
    return F.array_join(F.transform(options, lambda o, i: F.concat(F.lit(head), name(i), F.lit(sep), o)), "\n")


def render(template: Column, values: dict[str, Column]) -> Column:
    """template with {name} replaced for the given names; others stay as they are."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def messages(system: Column, user: Column, has_video: Column) -> Column:
    """Chat messages: a system one if there is such text, then the user's, which must not be empty."""
    checked = F.when(optional_text(user).isNotNull(), user).otherwise(F.raise_error(F.lit("empty user prompt")).cast("string"))
    message = lambda role, text, video: F.struct(F.lit(role).alias("role"), text.alias("content"), video.alias("has_video"))
    mine = message("user", checked, has_video)
    return F.when(optional_text(system).isNotNull(), F.array(message("system", system, F.lit(False)), mine)).otherwise(F.array(mine))


def legacy_prompt(system: Column, user: Column, has_video: Column, video_mark: Column) -> Column:
    """The same as one text, for a model without chat messages: the user's text, under headings if there is a system text; before it
    the mark of the video on a line of its own, unless the text has it already. The headings are fixed values."""
    checked = F.when(optional_text(user).isNotNull(), F.trim(user)).otherwise(F.raise_error(F.lit("empty user prompt")).cast("string"))
    both = F.concat(F.lit("System:\n"), F.trim(system), F.lit("\n\nUser:\n"), checked)
    whole = F.when(optional_text(system).isNotNull(), both).otherwise(checked)
    marked = has_video & (F.coalesce(video_mark, F.lit("")) != "") & ~F.contains(whole, video_mark)
    return F.when(F.coalesce(marked, F.lit(False)), F.concat(video_mark, F.lit("\n"), whole)).otherwise(whole)


def url_uid(url: Column) -> Column:
    """Name of an .mp4 file at the end of a URL's path, null without one."""
    return F.nullif(F.regexp_extract(url, r"/([^/?#]+)\.mp4(?:[?#]|$)", 1), F.lit(""))


def url_stem(url: Column) -> Column:
    """Last part of a URL's path without its extension."""
    last = F.regexp_extract(url, r"^[a-z]+://[^/?#]+/(?:[^?#]*/)?([^/?#]+)/?(?:[?#]|$)", 1)
    return F.nullif(F.regexp_replace(last, r"\.[A-Za-z0-9]+$", ""), F.lit(""))


def natural_key(name: Column) -> Column:
    """Sort key by which 'f9' comes before 'f10': digits padded to 20 places."""
    return F.transform(F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), 1), lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 20, "0")).otherwise(p))


def short_label(s: Column, width: int = 60) -> Column:
    return F.when(F.length(s) <= width, s).otherwise(F.concat(F.lit("..."), F.right(s, F.lit(width - 3))))


def safe_id(s: Column) -> Column:
    """An identifier as part of a path."""
    return F.regexp_replace(F.trim(s), r"[^0-9A-Za-z._-]+", "_")


def query_label(index: Column, query: Column) -> Column:
    return F.coalesce(F.concat(F.lit("q"), index.cast("string"), F.lit(": "), query), F.lit("n/a"))


def shown_number(x: Column, n: Column | None = None, unit: str = "") -> Column:
    """'%.4f', or with a number of samples '%.2f<unit> (n=..)'; N/A for null."""
    shown = F.format_string("%.4f", x) if n is None else F.format_string(f"%.2f{unit} (n=%d)", x, n)
    return F.when(x.isNull(), F.lit("N/A")).otherwise(shown)


def shown_bytes(x: Column, n: Column) -> Column:
    """'%.2f GiB (n=..)' of a number of bytes; N/A for null."""
    return shown_number(x / float(1 << 30), n, " GiB")


def shown_accuracy(correct: Column, labelled: Column) -> Column:
    """'%.4f' of their ratio; N/A if nothing is labelled."""
    return shown_number(F.when(labelled > 0, correct / labelled))


def submission_uid(candidates: list[Column], url: Column, fallback: Column) -> Column:
    """The first candidate that isn't blank, else the name of the URL's .mp4 file, else the fallback."""
    return F.coalesce(first_present(*candidates), url_uid(url), fallback)


def skip_reason(method: Column, prediction: Column) -> Column:
    """Why a row isn't submitted: its parse method if that found nothing, or no prediction; null if it is."""
    return F.when(method.isin("unparsed", "empty_response"), method).when(prediction.isNull(), F.lit("missing_prediction"))


def scaled(values: Column, by: float, kind: str = "double") -> Column:
    return F.transform(values, lambda x: (x * by).cast(kind))
