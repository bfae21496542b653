"""Japanese text rules as columns: width, blanks, controls, and which lines are worth keeping.

Null gives null everywhere. No function needs Python on the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Half-width kana and their full-width forms; the voicing marks become combining ones.
HALF_KANA = "ｦｧｨｩｪｫｬｭｮｯｰｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾜﾝﾞﾟ"
FULL_KANA = "ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン゙゚"
FULL_ALNUM = "０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ"
PLAIN_ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Every blank of Unicode, and format characters newer than Java 17's tables.
BLANKS = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
NEW_FORMATS = r"\x{0890}\x{0891}\x{13439}-\x{1343F}"
#: Signs of non-verbal lines, signs that don't count as text, and the ranges of kana and characters.
SOUND_SIGNS = r"()（）*＊\-….。、,，!！?？～~♪♫"
EMPTY_SIGNS = r"\-….。、,，!！?？～~♪♫「」『』（）()"
JAPANESE = r"\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}"
#: Words that say nothing alone.
FILLERS = tuple(
    "あっ あー ああ あの あのー あのう あら あれ いや いやいや うん うーん ううん えっ えー ええ ええと えーと おっ おー おお さあ さー ちょっ ちょっと ねえ ねー "
    "はい はっ はー はあ ふーん ふむ へー へえ まあ まー もし もしもし やっ やー わっ わー んー んっ".split()
)
MIN_CHARS = 2


#: Where the code points lie that the first two rules change.
WIDTHS = r"[\x{FF10}-\x{FF5A}\x{FF66}-\x{FF9F}]"


def full_kana(x: Column) -> Column:
    return F.translate(x, HALF_KANA, FULL_KANA)


def plain_alnum(x: Column) -> Column:
    return F.translate(x, FULL_ALNUM, PLAIN_ALNUM)


def squeeze_blanks(x: Column) -> Column:
    """Tabs and line breaks become a blank, several plain blanks one; other blanks stay."""
    return F.regexp_replace(F.regexp_replace(x, r"[\t\r\n]+", " "), " {2,}", " ")


def strip_controls(x: Column) -> Column:
    """Without controls, format characters and variation selectors; private characters stay."""
    return F.regexp_replace(x, rf"[\p{{Cc}}\p{{Cf}}\x{{FE00}}-\x{{FE0F}}{NEW_FORMATS}]", "")


def strip_blanks(x: Column) -> Column:
    """Without any blanks at both ends."""
    return F.regexp_replace(x, rf"^[{BLANKS}]+|[{BLANKS}]+\z", "")


def normalize_japanese(x: Column) -> Column:
    """The five rules in their fixed order. Controls go after blanks are squeezed, so a second pass may change more."""
    # few texts have signs of another width; both rules together are one look-up for each sign
    plain = F.when(x.rlike(WIDTHS), F.translate(x, HALF_KANA + FULL_ALNUM, FULL_KANA + PLAIN_ALNUM)).otherwise(x)
    return reduce(lambda y, f: f(y), (squeeze_blanks, strip_controls, strip_blanks), plain)


def is_non_verbal(x: Column) -> Column:
    return x.rlike(rf"^[{BLANKS}{SOUND_SIGNS}]+\z")


def has_japanese(x: Column) -> Column:
    return x.rlike(f"[{JAPANESE}]")


def bare_text(x: Column) -> Column:
    """Without blanks and signs that don't count as text."""
    return F.regexp_replace(x, rf"[{BLANKS}{EMPTY_SIGNS}]+", "")


def is_filler(x: Column) -> Column:
    b = bare_text(x)
    return (b == "") | b.isin(*FILLERS)


def reason_of(s: Column, b: Column, min_chars: int = MIN_CHARS) -> Column:
    """As ``filter_reason``, of a text without outer blanks and its ``bare_text``, which several of the rules need."""
    return (
        F.when(s == "", "empty")
        .when(is_non_verbal(s), "non_verbal")
        .when(~has_japanese(s), "no_japanese")
        .when(F.length(b) < min_chars, F.concat(F.lit("too_short("), F.length(b).cast("string"), F.lit(" chars)")))
        .when((b == "") | b.isin(*FILLERS), "filler_only")
        .otherwise("")
    )


def filter_reason(x: Column, min_chars: int = MIN_CHARS) -> Column:
    """Why a text is not worth keeping, the first reason that holds; the empty string where none does.

    Null counts as empty.
    """
    s = strip_blanks(F.coalesce(x, F.lit("")))
    return reason_of(s, bare_text(s), min_chars)


def pipe_escape(x: Column) -> Column:
    return F.replace(F.coalesce(x, F.lit("")), F.lit("|"), F.lit(" "))


def preview(text: Column, error: Column, size: int = 60, default: str = "") -> Column:
    """The start of the first that isn't empty."""
    return F.left(F.coalesce(F.nullif(text, F.lit("")), F.nullif(error, F.lit("")), F.lit(default)), F.lit(size))
