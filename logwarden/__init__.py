"""logwarden: threat scoring over log tables and log streams, on Spark.

Lines are matched against ordered regex rules, each hit is attributed to an
address, every address keeps a time-decaying score, and scores, manual lists and
a reputation feed become block decisions, firewall plans and abuse reports.
"""

from logwarden.settings import Settings

__all__ = ["Settings"]
