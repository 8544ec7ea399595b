"""What a page, a voice or a printout may show of checked rows: states, labels, links, questions and settlements.

All are expressions over the columns of checked rows; a wording is a parameter or stands beside its rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions import cues as C
from quillstone.functions import text as T


def one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "\\s+", " "))


def counted(n: Column, one: str, many: str) -> Column:
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, one).otherwise(many))


def explanation_state(quote: Column, explanation: Column, numbers_blocked: Column, cue_blocked: Column, reader: Column, verdict: Column) -> Column:
    """numbers, negation, none, checking, check_failed, unclear, certified or flagged: what becomes of an explanation.

    The checks by rule come first and are made again here; reader is idle, loading, error or done, verdict is what the
    second reader said of it (certified, different or null: it was not sent or not answered, which is never a yes).
    """
    return (
        F.when(F.coalesce(numbers_blocked, F.lit(False)), "numbers")
        .when(F.coalesce(cue_blocked, F.lit(False)), "negation")
        .when(F.coalesce(explanation, F.lit("")) == "", "none")
        .when(C.forbids(quote) | C.forbids(explanation), "negation")
        .when(reader.isin("idle", "loading"), "checking")
        .when(reader == "error", "check_failed")
        .when(verdict == "certified", "certified")
        .when(verdict == "different", "flagged")
        .otherwise("unclear")
    )


#: Words of reaching somebody and of going for care, in four languages.
REACH = "call calls calling phone contact notify tell text page seek ambulance hospital 911 er emergency urgent urgently immediate immediately llame llamar llámenos contacte avise emergencia urgencias inmediatamente appelez appeler contactez prévenez urgence urgences hôpital immédiatement gọi báo".split() + ["right away", "medical help", "medical care", "medical attention", "let us know", "liên lạc", "cấp cứu", "bệnh viện", "ngay lập tức", "atención médica"]
DIGITS_OF_A_PHONE = "(?:\\+?\\d[\\s().-]*){7,}"


def must_see(kind: Column, quote: Column) -> Column:
    """A step that is never folded away: it refuses or limits something, cannot be read, or is about reaching somebody."""
    return F.coalesce(kind == "call", F.lit(False)) | C.forbids(quote) | C.has(quote, REACH) | quote.rlike(DIGITS_OF_A_PHONE)


def closed_row(kind: Column, quote: Column) -> Column:
    """full, and the quote in one line: whole where it must be seen, else shortened."""
    full = must_see(kind, quote)
    return F.struct(full.alias("full"), F.when(full, one_line(quote)).otherwise(T.short_quote(quote)).alias("quote"))


def result_chip(status: Column, direction: Column) -> Column:
    """The tone of a result: high, low, flag, inside or unknown."""
    return F.when(status == "outside", F.when(direction.isin("high", "low"), direction).otherwise("flag")).when(status == "inside", "inside").otherwise("unknown")


def printed_name(line: Column, test: Column, value: Column) -> Column:
    """A test as its line prints it: all before the value, so that no part of its name is lost.

    The value counts where it is a word of its own after the test's name; a line without that name gives its first
    column, and one without the value the name itself.
    """
    literal = lambda c: F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    head = F.regexp_substr(line, F.concat(F.lit("(?is)^.*?(?<![\\p{L}\\p{N}])"), literal(test), F.lit("(?![\\p{L}\\p{N}])")))
    rest = F.substring(line, F.length(head) + 1, F.length(line))
    gap = F.when(value != "", F.regexp_substr(rest, F.concat(F.lit("(?s)^.*?(?=(?<!\\S)"), literal(value), F.lit("(?!\\p{N}))"))))
    name = F.trim(F.regexp_replace(F.concat(head, F.coalesce(gap, F.lit(""))), "[\\s:=]+$", ""))
    return F.coalesce(F.nullif(name, F.lit("")), F.trim(F.regexp_extract(line, "(?s)^(.*?)(?:\\s{2,}|\\t|$)", 1)))


def numbered_questions(rows: Column, lead: str) -> Column:
    """A text of struct(line, ask): each question after the line it is about, numbered from 1; blank ones are left out."""
    asked = F.filter(rows, lambda r: F.trim(F.coalesce(r["ask"], F.lit(""))) != "")
    return F.array_join(F.transform(asked, lambda r, i: F.concat((i + 1).cast("string"), F.lit(f'. {lead} "'), r["line"], F.lit('"\n   '), F.trim(r["ask"]))), "\n")


def phone_link(phone: Column) -> Column:
    return F.concat(F.lit("tel:"), F.regexp_replace(phone, "\\D", ""))


def encoded(c: Column) -> Column:
    """Percent-encoding of one part of an address: blanks as %20, and the marks !'()~ stay."""
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), {"+": "%20", "%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}.items(), F.url_encode(c))


def directions_link(base: str, address: Column, city: Column, code: Column, state: str) -> Column:
    """A link to directions; the state is added to a city that does not say it."""
    place = F.concat(address, F.lit(", "), city, F.when(F.contains(city, F.lit(",")), " ").otherwise(f", {state} "), code)
    return F.concat(F.lit(base), encoded(place))


def main_action(phone: Column, site: Column, place_link: Column, about: Column) -> Column:
    """action (call, apply, website, directions) and href of a card's one button; null if it has none of them.

    place_link is null for what is no place; about are the verified name and words, in which applying must be said.
    """
    act = lambda name, href: F.struct(name.alias("action"), href.alias("href"))
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    applies = place_link.isNull() & F.coalesce(about.rlike("(?i)\\bappl(?:y|ying|ication)\\b"), F.lit(False))
    return (
        F.when(given(phone), act(F.lit("call"), phone_link(phone)))
        .when(given(site), act(F.when(applies, "apply").otherwise("website"), site))
        .when(place_link.isNotNull(), act(F.lit("directions"), place_link))
    )


def step_question(kind: Column, quote: Column, unclear: Column, own: Column, check: Column, lead: str = "My paper says:") -> Column:
    """The question that a step brings to the next visit, or null: its own words only where they are certified."""
    mine, line = F.trim(F.coalesce(own, F.lit(""))), one_line(quote)
    ask = F.when(kind == "medication", F.lit("Can you confirm what I should take?")).otherwise("Can you help me understand what I should do?")
    by_rule = F.when((line != "") & ~F.coalesce(kind == "warning_sign", F.lit(False)), F.concat(F.lit(f'{lead} "'), line, F.lit('" '), ask))
    return F.when(F.coalesce(unclear, F.lit(False)) & (mine != ""), F.when(check == "certified", mine).otherwise(by_rule))


def general_questions(general: Column, steps: Column) -> Column:
    """General questions without those that a step asks, in whatever case and marks; steps: all of them, refused ones too."""
    key = lambda c: T.dedupe_key(F.coalesce(c, F.lit("")))
    return F.filter(general, lambda q: (key(q) != "") & ~F.exists(F.coalesce(steps, F.array().cast("array<string>")), lambda s: key(s) == key(q)))


def plan_lines(first: Column, summary: Column, steps: Column, needs_person: Column, reason: Column) -> Column:
    """Lines that are read aloud: steps (title, action, quotes) are numbered, and each is followed by the paper's words for it.

    A need for a person is said only where it is flagged and has a reason.
    """
    one = lambda s, i: F.concat(F.array(F.concat((i + 1).cast("string"), F.lit(". "), s["title"], F.lit(". "), s["action"])), F.transform(s["quotes"], lambda q: F.concat(F.lit('Your paper says: "'), q, F.lit('"'))))
    why = F.trim(F.coalesce(reason, F.lit("")))
    person = F.when(F.coalesce(needs_person, F.lit(False)) & (why != ""), F.array(F.concat(F.lit("This needs a person too: "), why))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(first, summary), F.flatten(F.transform(steps, one)), person)


def without_quotes(steps: Column) -> Column:
    return F.transform(steps, lambda s: F.struct(s["title"].alias("title"), s["action"].alias("action"), F.array().cast("array<string>").alias("quotes")))


def missed_lines_label(shown: Column, missed: Column) -> Column:
    """What is announced of the lines that no step covers: nothing while the section is hidden."""
    lines = F.concat_ws(" ", counted(missed, "line", "lines"), F.when(missed == 1, "looks").otherwise("look"), F.lit("like instructions but"), F.when(missed == 1, "is").otherwise("are"), F.lit("not in a step"))
    return F.when(~F.coalesce(shown, F.lit(False)), "").when(missed == 0, "every instruction is in a step").otherwise(lines)


def us_phone(c: Column) -> Column:
    """A number of the North American plan that may be called as +1 and ten digits, or null.

    Area and exchange begin with 2 to 9, are no service code (N11) and not 900 or 976; area codes of free calls (8xx
    with equal last digits) and the fictional 555-01xx are refused. Which area codes are in use is not looked up.
    """
    digits = F.regexp_replace(F.trim(c), "\\D", "")
    ten = F.when(digits.rlike("^1\\d{10}$"), F.substring(digits, 2, 10)).when(digits.rlike("^\\d{10}$") & ~F.trim(c).startswith("+"), digits)
    codes = [F.substring(ten, 1, 3), F.substring(ten, 4, 3)]
    fits = (F.length(c) <= 40) & F.trim(c).rlike("^\\+?[\\d\\s().-]+$") & ten.rlike("^[2-9]\\d{2}[2-9]\\d{6}$") & ~codes[0].rlike("^8(?:00|33|44|55|66|77|88)$") & ~ten.rlike("^...55501")
    for code in codes:
        fits = fits & ~code.rlike("^.11$") & ~code.isin("900", "976")
    return F.when(fits, F.concat(F.lit("+1"), ten))


def budget_changes(outcome: Column, reserved: Column, heard: Column, allowance: Column, most: int) -> Column:
    """site and client: by how much each one's reservation changes when a paid call ends.

    outcome: done (both pay what was heard), failed_sent (it may be billed: the site keeps its own, or what was heard),
    not_sent (the site gets its own back). A failure stays on the client's count. More heard than can be (most) uses up
    the client's allowance besides.
    """
    delta = heard - reserved
    site = F.when(outcome == "not_sent", -reserved).otherwise(delta)
    client = F.when(outcome == "done", delta).otherwise(0) + F.when((outcome == "done") & (heard > most), allowance).otherwise(0)
    return F.struct(site.cast("long").alias("site"), client.cast("long").alias("client"))


def public_call(phase: Column, number: Column, attempts: Column, most: int) -> Column:
    """phase (gone without a row), last four digits and attempts left: what a caller's own page may see of a call."""
    return F.struct(F.coalesce(phase, F.lit("gone")).alias("phase"), F.when(phase.isNotNull(), F.right(number, F.lit(4))).alias("last4"), F.when(phase.isNotNull(), F.greatest(F.lit(0), most - attempts)).cast("int").alias("attempts_left"))
