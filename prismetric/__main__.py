"""python -m prismetric"""

import sys

from .cli import main

sys.exit(main())
