"""Masking, escaping and transition codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Chromium's core transitions in code order, Firefox visit types from 1, human labels, flags.
CORE_TRANSITIONS = ("link", "typed", "auto_bookmark", "auto_subframe", "manual_subframe", "generated", "auto_toplevel", "form_submit", "reload", "keyword", "keyword_generated")
FIREFOX_TYPES = ("link", "typed", "bookmark", "embed", "redirect_permanent", "redirect_temporary", "download", "framed_link", "reload")
LABELS = {
    "link": "clicked link", "typed": "typed URL", "auto_bookmark": "bookmark", "bookmark": "bookmark", "auto_subframe": "subframe (auto)", "manual_subframe": "subframe (manual)",
    "generated": "generated", "auto_toplevel": "start page", "start_page": "start page", "form_submit": "form submit", "reload": "reload", "keyword": "keyword search",
    "keyword_generated": "keyword search", "embed": "embedded object", "redirect_permanent": "redirect (permanent)", "redirect_temporary": "redirect (temporary)", "download": "download", "framed_link": "framed link",
}
FROM_ADDRESS_BAR, CHAIN_START, CHAIN_END, CLIENT_REDIRECT, SERVER_REDIRECT = 0x02000000, 0x10000000, 0x20000000, 0x40000000, 0x80000000
#: File endings that run or install something.
EXECUTABLE = (
    "exe dll scr msi msp com bat cmd ps1 vbs vbe js jse jar apk app dmg pkg deb rpm sh run wsf hta cpl msc gadget lnk reg sys iso".split()
)


def mask_secrets(text: Column) -> Column:
    """Words joined by one space; mail addresses and long tokens with a digit masked."""
    def mask(t: Column) -> Column:
        domain = F.regexp_replace(t, "^[^@]*@", "")
        mail = t.rlike("^[^@]+@") & domain.contains(".") & ~domain.endswith(".")
        secret = t.rlike(r"^[A-Za-z0-9+/=_.-]{24,}$") & t.rlike("[0-9]")
        return F.when(mail, "[redacted-email]").when(secret, "[redacted]").otherwise(t)

    return F.array_join(F.transform(F.filter(F.split(text, r"\s+"), lambda x: x != ""), mask), " ")


def unsigned(c: Column) -> Column:
    """The low 32 bits, as a transition code is read."""
    return c.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def transition_core(c: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in CORE_TRANSITIONS]), unsigned(c).bitwiseAND(255).cast("int")), F.lit("unknown"))


def has_flag(c: Column, flag: int) -> Column:
    return unsigned(c).bitwiseAND(F.lit(flag).cast("long")) != 0


def redirect_kind(c: Column) -> Column:
    return F.when(has_flag(c, SERVER_REDIRECT), "server").when(has_flag(c, CLIENT_REDIRECT), "client")


def firefox_type(c: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in FIREFOX_TYPES]), (c - 1).cast("int")), F.lit("unknown"))


def transition_label(token: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), token), F.lit("unknown"))


def is_executable(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return name.contains(".") & F.lower(F.substring_index(name, ".", -1)).isin(*EXECUTABLE)


def bodyfile_field(c: Column) -> Column:
    """Without what would break a row: bars become slashes, line breaks spaces."""
    return F.translate(c, "|\n\r", "/  ")


def csv_field(c: Column) -> Column:
    """Quoted where needed, and guarded against formulas."""
    guarded = F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)
    return F.when(guarded.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(guarded)


def user_of(path: Column) -> Column:
    """The folder below the last ``Users`` or ``home`` of a path."""
    return F.nullif(F.regexp_extract(path, r"(?i)^(?:.*[/\\])?(?:users|home)[/\\]([^/\\]+)", 1), F.lit(""))  # extracted once
