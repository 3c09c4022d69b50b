from tracelake.cli import main

raise SystemExit(main())
