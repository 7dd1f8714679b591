"""Descriptions, references and document text, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: words that say nothing about a payment (fixed values)
STOPWORDS = ("the", "to", "from", "by", "for", "and", "of", "a", "an", "in", "on", "at", "ltd", "pvt", "inc")
#: spending categories in the order they are tried, with their keywords (fixed values)
CATEGORIES = (
    ("Food & Dining", ("zomato", "swiggy", "uber eats", "doordash", "restaurant", "cafe", "starbucks", "mcdonald", "domino", "burger", "pizza", "coffee", "diner", "food", "bakery", "bar", "pub", "bistro", "eatery")),
    ("Groceries", ("supermarket", "grocery", "blinkit", "zepto", "instacart", "walmart", "costco", "target", "whole foods", "dmart", "bigbasket", "trader joe", "provision", "mart", "hypermarket", "market")),
    ("Utilities & Bills", ("electricity", "water", "gas", "power", "broadband", "wifi", "telecom", "airtel", "jio", "verizon", "at&t", "utility", "bill desk", "bescom", "tneb", "recharge", "postpaid", "prepaid", "insurance", "lic")),
    ("Travel & Commute", ("uber", "ola", "lyft", "flight", "airline", "irctc", "train", "metro", "fuel", "petrol", "shell", "parking", "toll", "fastag", "railway", "indigo", "air india", "cab", "taxi")),
    ("Shopping", ("amazon", "flipkart", "myntra", "ebay", "zara", "h&m", "apparel", "retail", "clothing", "mall", "store", "electronics", "apple store")),
    ("Entertainment & Subscriptions", ("netflix", "spotify", "cinema", "pvr", "theatre", "movie", "hotstar", "youtube", "disney", "prime video", "apple.com", "google play", "openai", "chatgpt", "github", "adobe", "gym", "cult.fit", "hulu", "audible", "patreon", "substack", "dropbox", "canva", "playstation")),
    ("Salary & Income", ("salary", "payroll", "dividend", "interest", "bonus", "stipend", "income", "refund", "remittance received", "credit interest")),
    ("Investments", ("zerodha", "groww", "mutual fund", "sip", "stock", "etf", "vanguard", "fidelity", "crypto", "binance", "coinbase", "securities")),
    ("Transfers & UPI", ("upi", "neft", "rtgs", "imps", "transfer to", "p2p", "venmo", "zelle", "cashapp", "fund transfer", "sent to")),
)
OTHER_CATEGORY = "Miscellaneous"
#: merchants whose charges recur, in the order they are tried (fixed values)
SUBSCRIPTIONS = ("netflix", "spotify", "prime", "hotstar", "youtube", "apple", "icloud", "google storage", "openai", "chatgpt", "github", "adobe", "gym", "cult.fit", "disney", "hulu", "audible", "patreon", "substack", "dropbox", "canva", "zoom", "notion", "slack", "medium", "figma")


def first_hit(text: Column, choices: list[tuple[str, tuple[str, ...]]]) -> Column:
    """The name of the first choice one of whose words the lower-cased text contains, else null."""
    lowered, found = F.lower(text), None
    for name, words in choices:
        hit = F.lit(False)
        for w in words:
            hit = hit | lowered.contains(w)
        found = F.when(hit, F.lit(name)) if found is None else found.when(hit, F.lit(name))
    return found


def category(description: Column) -> Column:
    return F.coalesce(first_hit(description, list(CATEGORIES)), F.lit(OTHER_CATEGORY))


def subscription(description: Column) -> Column:
    """The recurring merchant's name in title case, null for none."""
    return first_hit(description, [(m.title(), (m,)) for m in SUBSCRIPTIONS])


def normal_reference(reference: Column) -> Column:
    """Upper-case letters and digits only, empty for null."""
    return F.coalesce(F.regexp_replace(F.upper(F.trim(reference)), "[^A-Z0-9]", ""), F.lit(""))


def tokens(description: Column) -> Column:
    """Sorted distinct words of two or more characters that are no stopwords and not all digits."""
    # runs of letters and digits with a letter among them
    words = F.regexp_extract_all(F.lower(F.coalesce(description, F.lit(""))), F.lit("[0-9]*+[a-z][a-z0-9]*+"), F.lit(0))
    return F.sort_array(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*STOPWORDS))))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token arrays, 0 where either is empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / either).otherwise(F.lit(0.0))


def references_match(a: Column, b: Column) -> Column:
    """Equal references that are no short serial, or one of six characters or more within the other."""
    shorter = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    longer = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    equal = (F.length(a) >= 3) | ~a.rlike("^[0-9]+$")
    return (a != "") & (b != "") & F.when(a == b, equal).otherwise((F.length(shorter) >= 6) & longer.contains(shorter))


def snippet(text: Column, n: int = 200) -> Column:
    return F.substring(text, 1, n)


def head_and_tail(text: Column, head: int = 7000, tail: int = 3000, gap: str = "\n...\n") -> Column:
    """Long texts cut to their beginning and end."""
    cut = F.concat(F.substring(text, 1, head), F.lit(gap), F.substring(text, -tail, tail))
    return F.when(F.length(text) > head + tail, cut).otherwise(text)


def normal_space(text: Column) -> Column:
    """Runs of blanks to one, lines trimmed, runs of empty lines to one, ends trimmed."""
    lines = F.transform(F.split(text, "\n"), lambda line: F.trim(F.regexp_replace(line, r"[ \t]+", " ")))
    joined = F.array_join(lines, "\n")
    return F.regexp_replace(F.regexp_replace(joined, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
