"""String functions on columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from trialspark.schemas import ADVERBS, MS_PER_WORD

BLANK = r"\[(?:su|o)bj\]"


def pad_left(number: Column, width: int, fill: str = "0") -> Column:
    """Left pad that never cuts a longer text."""
    text = number.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, fill)).otherwise(text)


def clock_label(ms: Column) -> Column:
    """Milliseconds as ``mm:ss.mmm``; minutes may take more than two digits."""
    minutes = ms / F.lit(60_000.0)
    seconds = (minutes % 1) * 60
    millis = (seconds % 1) * 1000
    return F.concat(
        pad_left(_toward_zero(minutes), 2), F.lit(":"),
        pad_left(_toward_zero(seconds), 2), F.lit("."),
        pad_left(F.round(millis).cast("bigint"), 3),
    )


def _toward_zero(number: Column) -> Column:
    return number.cast("bigint")


def word_count(sentence: Column) -> Column:
    """Number of blanks plus one."""
    return F.length(sentence) - F.length(F.replace(sentence, F.lit(" "), F.lit(""))) + 1


def reading_delay(sentence: Column, ms_per_word: int = MS_PER_WORD) -> Column:
    """Milliseconds a reader is given before the word appears."""
    return word_count(sentence).cast("bigint") * ms_per_word


def decode_feedback(text: Column) -> Column:
    """Undo the escapes of commas and line ends; other escapes stay as they are."""
    commas = F.replace(text, F.lit("%2C"), F.lit(","))
    return F.replace(commas, F.lit("%0A"), F.lit("\n"))


def title_case(text: Column) -> Column:
    """First letter of each word upper, the rest lower; hyphens and slashes end a word."""
    # A marked blank after each separator lets initcap see the words it divides.
    for separator in "-/(":
        text = F.replace(text, F.lit(separator), F.lit(f"{separator}\u0001 "))
    return F.replace(F.initcap(text), F.lit("\u0001 "), F.lit(""))


def model_label(name: Column) -> Column:
    """Title case with the model family spelled ``BERT``."""
    label = F.replace(title_case(name), F.lit("Bert"), F.lit("BERT"))
    return F.replace(label, F.lit("bert"), F.lit("BERT"))


def clean_token(token: Column) -> Column:
    """Drop the word-start mark that byte-level tokenizers put in front."""
    return F.when(token.startswith("Ġ"), F.substr(token, F.lit(2))).otherwise(token)


def sentence_case(text: Column) -> Column:
    """Capitalise each run of two or more non-digits and lower its rest."""
    runs = F.regexp_extract_all(text, F.lit(r"\d+|\D+"), F.lit(0))
    by_run = F.transform(
        runs, lambda run: F.when(run.rlike(r"^\d"), run).otherwise(_capitalise(run))
    )
    return F.when(text.rlike(r"\d"), F.array_join(by_run, "")).otherwise(_capitalise(text))


def _capitalise(run: Column) -> Column:
    changed = F.concat(F.upper(F.substring(run, 1, 1)), F.lower(F.substr(run, F.lit(2))))
    return F.when(F.length(run) > 1, changed).otherwise(run)


def alt_response(ratio_name: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(ratio_name, "/", -1)


def eval_group(eval_data: Column) -> Column:
    """Argument group inside the name of a filler evaluation set."""
    return F.regexp_replace(eval_data, "(?s)syn_(.*?)_ext_for_human_exp", "$1")


def group_label(args_group: Column) -> Column:
    """Display form of an argument group; a missing one is written ``NA``."""
    plus = F.coalesce(F.replace(args_group, F.lit("_"), F.lit("+")), F.lit("NA"))
    return F.concat(plus, F.lit(" args"))


def find_adverb(sentence: Column, adverbs: Sequence[str] = ADVERBS) -> Column:
    """The first adverb of the list that occurs, by list order; NULL if none does."""
    return F.coalesce(*(F.when(sentence.contains(a), F.lit(a)) for a in adverbs))


def split_template(sentence: Column) -> Column:
    """Struct of the text around and the names of the first two blanks."""
    around = F.split(sentence, BLANK, -1)
    blanks = F.regexp_extract_all(sentence, F.lit(BLANK), F.lit(0))
    part = {
        "before": F.get(around, F.lit(0)),
        "first_blank": F.get(blanks, F.lit(0)),
        "middle": F.get(around, F.lit(1)),
        "second_blank": F.get(blanks, F.lit(1)),
        "after": F.element_at(around, -1),
    }
    return F.struct(*(c.alias(n) for n, c in part.items()))


def recode(column: Column, mapping: dict[str, str]) -> Column:
    """Dictionary recode in one step; values outside the dictionary become NULL."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), column)


def rank_of(column: Column, levels: Sequence[str]) -> Column:
    """1-based display rank: listed levels first, all others after them."""
    place = F.array_position(F.array(*(F.lit(v) for v in levels)), column)
    return F.when(place == 0, len(levels) + 1).otherwise(place)


# Abbreviations in coefficient names, in reports and in plots.
REPORT_WORDS = {
    "Svo": "SVO", "Ovs": "OVS", " Tr ": " Target response ", " Ds ": " Data source ",
    " Sit ": " Seen in Training ", " v ": " Voice ", " l ": " Linear ", "Bert": "BERT",
}
PLOT_WORDS = {
    "Svo": "SVO", "Ovs": "OVS", " Tr ": " T.R. ", " Ds ": " D.S. ", " Sit ": " S.i.T. ",
    " v ": " V. ", " l ": " L. ", "Bert": "BERT", "(": "", ")": "",
}


def effect_label(parameter: Column, words: dict[str, str] = REPORT_WORDS) -> Column:
    """Readable name of a model coefficient, as in reports or, with PLOT_WORDS, plots."""
    out = F.regexp_replace(parameter, "^b_", "")
    out = F.regexp_replace(out, r"\.n(_|:|$)", "$1")
    out = F.replace(out, F.lit("_i_n_"), F.lit(" (in) "))
    out = F.replace(out, F.lit("_a_t_"), F.lit(" @ "))
    out = F.regexp_replace(out, "[._]", " ")
    out = F.replace(out, F.lit(":"), F.lit(" × "))
    out = first_letters_upper(out)
    for short, long in words.items():
        out = F.replace(out, F.lit(short), F.lit(long))
    return out


def find_all(text: Column, pattern: str) -> Column:
    """All matches of a pattern, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


# Words a title leaves in lower case, and words it leaves as written.
LOWER_IN_TITLES = [
    "a", "and", "are", "as", "at", "be", "but", "by", "en", "for", "if", "in", "is", "nor",
    "not", "of", "on", "or", "per", "so", "the", "v", "via", "vs", "from", "into", "than",
    "that", "with",
]
AS_WRITTEN_IN_TITLES = [
    "all", "above", "after", "along", "also", "among", "any", "both", "can", "few", "it",
    "less", "log", "many", "more", "over", "some", "their", "then", "this", "under",
    "until", "using", "von", "when", "where", "which", "will", "without", "yet", "you",
    "your",
]


def first_letters_upper(text: Column) -> Column:
    """Title case of a label: first letters up, single letters and short words left alone."""
    words = F.regexp_extract_all(text, F.lit(r'[^ \-/"()\n\t]+|[ \-/"()\n\t]'), F.lit(0))

    def one(word: Column, position: Column) -> Column:
        short = (position > 0) & F.lower(word).isin(LOWER_IN_TITLES)
        as_is = (
            (F.length(word) == 1)
            | word.isin(AS_WRITTEN_IN_TITLES)
            | word.rlike(r"^\p{L}.*\p{Lu}")
            | ~word.rlike("^[a-z]")
        )
        upper = F.concat(F.upper(F.substring(word, 1, 1)), F.substr(word, F.lit(2)))
        return F.when(short, F.lower(word)).when(as_is, word).otherwise(upper)

    return F.array_join(F.transform(words, one), "")
