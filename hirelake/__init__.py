"""Job-listing analytics as Spark DataFrame operators.

Landed payloads are normalised into one listing shape, filtered, deduplicated,
scored against a profile and preferences, ranked with company variety, kept in
a seen table and browsed.  Every operator is a lazy DataFrame transformation or
a column expression; the as-of time is always an argument.
"""

from hirelake.schema import Preferences, Profile, Vocabulary
from hirelake.session import configure

__all__ = ["Preferences", "Profile", "Vocabulary", "configure"]
