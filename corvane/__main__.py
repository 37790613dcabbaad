import sys

from corvane.plans.cli import main

sys.exit(main())
