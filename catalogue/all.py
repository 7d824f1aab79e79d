"""Importing this module fills the registry."""

import catalogue.star  # noqa: F401  isort: skip
import catalogue.business  # noqa: F401
import catalogue.governed  # noqa: F401
import catalogue.dashboard  # noqa: F401
import catalogue.channels  # noqa: F401
import catalogue.mixes  # noqa: F401
import catalogue.faults  # noqa: F401
import catalogue.checks  # noqa: F401
import catalogue.churn  # noqa: F401
import catalogue.scores  # noqa: F401
import catalogue.raw  # noqa: F401
