import sys

from tapeloom.cli import main

sys.exit(main())
