"""The pure parts of a mail tool: whether its settings are complete, and how subject and body are wrapped. Nothing is sent from here."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The settings that a mail server needs, and what stands before a subject.
SETTINGS = ["SMTP_SERVER", "SMTP_PORT", "SMTP_USERNAME", "SMTP_PASSWORD"]
SUBJECT = "[CHATBOT] "


def mail_settings(env: Mapping[str, str]) -> dict[str, object] | None:
    """server, port, username and password; None unless all four are set."""
    values = [env.get(name) for name in SETTINGS]
    if not all(values):
        return None
    return {"server": values[0], "port": int(values[1]), "username": values[2], "password": values[3]}


def is_configured(settings: Column) -> Column:
    """Of a map of settings: whether all four are present and not empty."""
    ok = F.lit(True)
    for name in SETTINGS:
        ok = ok & (F.coalesce(settings[name], F.lit("")) != "")
    return F.coalesce(ok, F.lit(False))


def wrapped_subject(subject: Column) -> Column:
    return F.concat(F.lit(SUBJECT), F.coalesce(subject, F.lit("")))


def wrapped_body(body: Column, recipient: Column, sender: str = "automatic sender") -> Column:
    """The body between a head that names recipient and sender and a closing line."""
    return F.concat(F.lit("[AUTOMATIC MESSAGE]\nTo: "), recipient, F.lit(f"\nFrom: {sender}\n\n---\n\n"), F.coalesce(body, F.lit("")), F.lit("\n\n---\nThis message was sent automatically."))
