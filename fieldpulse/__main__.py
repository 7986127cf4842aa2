import sys

from fieldpulse.cli import main

sys.exit(main())
