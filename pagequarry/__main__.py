import sys

from pagequarry.cli import main

sys.exit(main())
