"""``python -m tidemark <command> ...`` runs the job driver (see ``tidemark.cli``)."""

import sys

from tidemark.cli import main

sys.exit(main())
