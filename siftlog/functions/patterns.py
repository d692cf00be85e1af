"""Regular expressions of the text functions, for Java's engine. Each class of the template mask is written on its own and joined in priority order."""

from __future__ import annotations

HEX, PATH = "[0-9A-Fa-f]", r"[A-Za-z0-9_/.\-+~%]"
OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d{1,2})(?!\d)"
#: One to five digits, at most 65535, not followed by a sixth.
PORT = r"(?:6553[0-5]|655[0-2]\d|65[0-4]\d{2}|6[0-4]\d{3}|[0-5]\d{4}|\d{1,4})(?!\d)"
IPV4 = rf"{OCTET}(?:\.{OCTET}){{3}}"
HMS = r"(?:[01]\d|2[0-3]):[0-5]\d:(?:[0-5]\d|60)(?:\.\d{1,9}(?!\d))?+(?!\d)"
ZONE = r"(?:[Zz](?!\w)|[+-](?:[01]\d|2[0-3]):?[0-5]\d(?!\d))"
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"


def ipv6(guard: str) -> str:
    """All spellings of an IPv6 address; the guard stands inside each, so that a spelling that it refuses gives way to the next.

    An address has eight groups, the last two of which an IPv4 address may replace; one run of groups may be left out as ::.
    """
    h = f"{HEX}{{1,4}}"
    ways = [f"{h}(?::{h}){{5}}:{IPV4}", f"{h}(?::{h}){{7}}"]
    for before in range(7, -1, -1):
        left = "" if not before else h if before == 1 else f"{h}(?::{h}){{{before - 1}}}"
        after = 7 - before
        tails = [f"(?:{h}:){{0,{after - 2}}}{IPV4}"] if after >= 2 else []
        if after:
            tails.append(f"{h}(?::{h}){{0,{after - 1}}}+" if after > 1 else h)
        if before:
            tails.append("")
        ways += [f"{left}::{t}" for t in tails]
    return "(?:" + "|".join(f"{w}{guard}" for w in ways) + ")"


# The classes of variable tokens.
MASK_CLASSES = {
    "literal path": r"((?<!" + PATH + r")/[A-Za-z_/.\-+~%]++(?!\d))",
    "path": r"(?<!" + PATH + r")/(?=[A-Za-z_/.\-+~%]*+\d)" + PATH + "++",
    "uuid": rf"(?<!\w){HEX}{{8}}-{HEX}{{4}}-{HEX}{{4}}-{HEX}{{4}}-{HEX}{{12}}(?![0-9A-Fa-f\-])",
    "block": r"(?<![A-Za-z_])blk_-?\d++(?:(?!\w)|(?=blk_))",
    "ipv6": rf"(?:\[{ipv6(chr(92) + ']')}(?::{PORT}(?!\w)|(?!:))|(?<!\w){ipv6(r'(?![\w:.])')})",
    "ipv4": rf"(?<![\d.]){IPV4}(?::{PORT}(?![\w.])|(?![\w.:]))",
    "iso": rf"(?<!\w)\d{{4}}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?:[Tt]{HMS}{ZONE}?+| {HMS}{ZONE}?+|(?![Tt]))(?!\w)",
    "syslog": rf"(?<![A-Za-z])(?:{MONTHS}) ++(?:3[01]|[12]\d|0?[1-9])(?!\d) ++{HMS}",
    "time": rf"(?<!\d){HMS}",
    "hex": rf"(?:(?<!\w)0[xX]{HEX}{{6,}}+|(?<!{HEX})(?!0[xX])(?=\d*+[A-Fa-f]){HEX}{{6,}}+)",
    "decimal": r"(?<!\w)[+-]?\d++(?!\w)",
}
#: Every class starts with one of these characters.
MASK = "(?=[0-9A-Fa-f:/+\\-\\[bJFMASOND])(?:" + "|".join(MASK_CLASSES.values()) + ")"
#: Only texts that match this can hold a variable token.
MASK_HINT = r"[0-9]|[A-Fa-f]{6}|::|(?:[A-Fa-f]{1,4}:){7}"
MASKED = "<*>"

#: A letter or digit of ASCII, or anything beyond it. A run starts where no such character stands before it: else a run
#: without a joiner behind it would be tried again from each of its characters.
CHAR = r"[A-Za-z0-9\x{80}-\x{10FFFF}]"
RUN = f"{CHAR}++"
COMPOUND = rf"(?<!{CHAR}){CHAR}++(?:[-_.:]++{CHAR}++)++"

# Shapes of identifiers. The whole token has to match.
IDENTIFIER = "|".join(
    (
        rf"{HEX}{{8}}-{HEX}{{4}}-{HEX}{{4}}-{HEX}{{4}}-{HEX}{{12}}",
        rf"(?:0[xX])?(?=[A-Fa-f]*\d){HEX}{{8,}}",
        r"[0-9]{4,}",
        r"[A-Za-z]{2,10}[-_]-?[A-Za-z]?[0-9]{3,}",
        rf"{IPV4}(?::0*+(?:6553[0-5]|655[0-2]\d|65[0-4]\d{{2}}|6[0-4]\d{{3}}|[0-5]?\d{{1,4}}))?",
        ipv6(""),
        rf"\[{ipv6('')}\]:0*+(?:6553[0-5]|655[0-2]\d|65[0-4]\d{{2}}|6[0-4]\d{{3}}|[0-5]?\d{{1,4}})",
        r"(?:/[^/\s]+){2,}/?",
    )
)
