"""visitlens: web-traffic and bot-behaviour analytics as Spark DataFrame functions."""

from visitlens.settings import DEFAULT, Settings

__all__ = ["DEFAULT", "Settings"]
