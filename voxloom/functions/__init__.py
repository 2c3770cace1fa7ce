"""Column -> Column building blocks (JVM-side expressions only)."""

from voxloom.functions.arrays import *  # noqa: F401,F403
from voxloom.functions.text import *  # noqa: F401,F403
