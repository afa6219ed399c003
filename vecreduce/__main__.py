import sys

from vecreduce.cli import main

sys.exit(main())
