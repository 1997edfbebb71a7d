"""``python -m claimtext <job> <args...>``: the batch jobs of ``claimtext.jobs``."""

from claimtext.jobs import main

main()
