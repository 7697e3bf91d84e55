from dupscan.cli import main

main()
